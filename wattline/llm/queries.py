"""The registered queries of the operators, over whole tables with production
parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, chat, divergence, exact_dedup, hpylm, langid, licences, packing, quality, quality_rules, runs, simhash,
    token_counts,
)
from .common import fold, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(table(spark, sf_dir, "documents"), train=fold("doc_id", 7) != 2)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), width=4, distance=4)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=False)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marked).alias("text"),
    )
    messages = chat.fold_messages(chat.turns_as_events(turns.unionByName(own)))
    return chat.conversation_digests(chat.render(messages), ["place"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    found = langid.with_language(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", (fold("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), budget=4096)
    return found.select("row.doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs.filter(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    found = quality.with_quality(docs, model)
    return found.select(
        "row.doc_id", (fold("row.doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text); with h = crc32 of the id, g = h / 10 and n words,
    each word i >= a of a text with h % 10 = 0 becomes word a + (i - a) % p,
    where a = g % n and p = 1 + (n - a) / (3 + g % 8). Other texts (a null id
    has no h) stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    cut = cut.withColumn("a", F.expr("if(size(w) > 0, g % size(w), null)"))
    cut = cut.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    turned = F.expr("transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)]))")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs, least=12).select("row.doc_id", "runs", "collapsed")
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as back, -r.period as less, r.start, r.period)))")
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    found = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"), least_texts=10, top=10)


def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.licence_spans(docs, licences.templates(), licences.PHRASES, least=5, coverage=0.8)
    sorted_labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, method = F.col("places.label"), F.col("spans.label")
    return found.select(
        "row.doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        sorted_labels(base).alias("base_labels"), sorted_labels(F.concat(base, method)).alias("labels"),
        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("score"), "spans",
    )


LLM_QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_licence_scan": op13_licence_scan,
}

LLM_ORACLE = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept,
               sha256(content) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id)""",
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        word AS (
            SELECT row_no, lang, source,
                   unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT row_no) >= 10),
        size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        grp AS (SELECT DISTINCT lang, source FROM d),
        cell AS (
            SELECT w.lang, w.source, w.term, count(*) AS n FROM word w JOIN kept k ON w.lang = k.lang AND w.term = k.term
            GROUP BY ALL),
        tot AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL),
        p AS (
            SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * s.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 2)) // (s.total + 2 * s.v) AS q
            FROM kept k JOIN grp g ON k.lang = g.lang JOIN size s ON k.lang = s.lang
            LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source
            LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y
                             ON x.lang = y.lang AND x.term = y.term
                             WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
            FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
        one AS (
            SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
            FROM p WHERE n > 0 AND p > q),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
            FROM (SELECT * FROM pair UNION ALL SELECT * FROM one))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
