import re
import zlib

import numpy as np
import xxhash

import corpus_pipeline
from wattline.llm import langid, packing, quality
from wattline.llm.common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows, before = kept.collect(), {r["doc_id"]: r for r in docs.collect()}
        assert all(before[r["doc_id"]] == r for r in rows), name
        assert len({r["doc_id"] for r in rows}) == len(rows)
        sizes.append((len(before), len(rows)))
        docs = spark.createDataFrame(rows, docs.schema)
    assert all(a >= b > 0 for a, b in sizes)
    # near duplicates of what is left: none
    from wattline.llm.simhash import simhash_groups

    groups = simhash_groups(docs).collect()
    assert all(g["component_id"] == g["doc_id"] for g in groups)


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    whole = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(whole) > 100
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in whole)


def test_clean_documents_stay(spark):
    """Labelled good documents are lost to the two filters in a few cases at most."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    for stage in (corpus_pipeline.language_id, corpus_pipeline.quality_filter):
        kept = stage(spark, docs, SF).join(good.select("doc_id"), "doc_id", "left_semi")
        assert kept.count() >= 0.95 * good.count()


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
                assert out.count() <= docs.count()
            else:
                assert docs.isEmpty() == out.isEmpty()


# ---------------------------------------------------------------- plain loops


def plain_exact(docs):
    """Of equal texts, white space aside: the longest, then the smallest id."""
    groups = {}
    for d in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d["text"] or ""), []).append(d)
    return {min(g, key=lambda d: (-len(d["text"] or ""), d["doc_id"]))["doc_id"] for g in groups.values()}


def plain_simhash(docs):
    """The smallest id of each component of fingerprints within four bits."""
    prints = {}
    for d in docs:
        words = (d["text"] or "").translate(LOWER).encode().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    ids, root = sorted(prints), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i for i in ids if find(i) == i}


def test_every_stage_against_a_plain_loop(spark):
    """Each stage's kept ids on the rows that the one before kept: the models' own
    answers text by text, plain groups, all pairs of fingerprints, and the pieces."""
    labels = table(spark, SF, "labels")
    docs = table(spark, SF, "documents").collect()
    schema = table(spark, SF, "documents").schema
    frame = lambda rows: spark.createDataFrame(rows, schema)
    kept = lambda stage, rows: {r["doc_id"] for r in stage(spark, frame(rows), SF).collect()}
    only = lambda ids: [d for d in docs if d["doc_id"] in ids]

    fold = lambda d, n: zlib.crc32(str(d["doc_id"]).encode()) % n
    model = langid.fit(frame([d for d in docs if fold(d, 4) != 2]))
    names, scores = model.predict([d["text"] for d in docs])
    want = {d["doc_id"] for d, n, s in zip(docs, names, scores) if n != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert kept(corpus_pipeline.language_id, docs) == want
    docs = only(want)

    model = quality.fit(frame([d for d in docs if fold(d, 5) != 0]), labels)
    scores = model.scores(np.array([quality.statistics(d["text"]) for d in docs]))
    want = {d["doc_id"] for d, s in zip(docs, scores) if s >= corpus_pipeline.LEAST_QUALITY}
    assert kept(corpus_pipeline.quality_filter, docs) == want
    docs = only(want)

    want = plain_exact(docs)
    assert kept(corpus_pipeline.exact_dedup, docs) == want
    docs = only(want)

    want = plain_simhash(docs)
    assert kept(corpus_pipeline.near_dedup, docs) == want
    docs = only(want)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.PACKING_TOKENIZER)
    ids = {d["doc_id"]: [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1] for d in docs}
    sequences, covered = {}, {i: 0 for i in ids}
    for p in corpus_pipeline.packing(spark, frame(docs), SF).orderBy("doc_id", "start").collect():
        own = ids[p["doc_id"]]
        assert p["start"] == covered[p["doc_id"]] and p["doc_tokens"] == len(own)
        covered[p["doc_id"]] += p["length"]
        part = np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert p["ids_crc32"] == zlib.crc32(part)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert covered == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
