"""Quality rules with a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into buckets. Two multinomials over the
buckets are counted, one over trusted target texts, one over the raw corpus; a
document's score is the log-likelihood ratio of its n-grams divided by their
number. Every document is kept or dropped by the sign of score minus
threshold; nothing is drawn at random. DataFrame expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192
THRESHOLD = -0.1
_SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), _SPACES)
    return F.filter(parts, lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words that lie in a window of ``width`` words which the text
    holds twice or more. Hashes of the windows tell whether any repeats; only
    then are the windows themselves sorted and compared."""

    def windows(ws: Column, of: Callable[[Column, Column], Column]) -> Column:
        return F.when(F.size(ws) >= width, F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: of(ws, i)))

    def covered(at: Column) -> Column:
        # at: positions of repeated windows, ascending; each covers up to the next one's start
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))),
            F.lit(0).cast("long"), lambda acc, x: acc + x,
        )

    def positions(ordered: Column) -> Column:
        same = lambda e, other: other["w"].eqNullSafe(e["w"])
        return F.sort_array(F.array_compact(F.transform(ordered, lambda e, k: F.when(
            same(e, F.get(ordered, k + 1)) | ((k > 0) & same(e, F.get(ordered, F.greatest(k - 1, F.lit(0))))), e["i"]
        ))))

    def exact(ws: Column) -> Column:
        texts = windows(ws, lambda w, i: F.struct(F.array_join(F.slice(w, i + 1, width), " ").alias("w"), i.alias("i")))
        return let(F.sort_array(texts), lambda ordered: let(positions(ordered), covered))

    hashes = windows(words, lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    found = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.coalesce(F.when(found, exact(words)), F.lit(0).cast("long"))


def base_rules(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words, and the counts that the base rules use)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        words_of(F.col(text_col)).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    )
    return rows.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def bucket(*grams: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(len(grams)), *grams), F.lit(buckets)).cast("int")


def bucket_counts(docs: DataFrame, text_col: str, weight: Column, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows and of those with weight 1,
    combined in each task before the shuffle; at most ``buckets`` rows."""
    rows = docs.select(words_of(F.col(text_col)).alias("ws"), weight.cast("long").alias("trusted"))
    pairs = F.explode(F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", F.lit(2), F.greatest(F.size("ws"), F.lit(1))).alias("b")))
    rows = rows.select(pairs.alias("p"), "trusted").select(
        F.explode(F.array(
            bucket(F.col("p.a"), buckets=buckets),
            F.when(F.col("p.b").isNotNull(), bucket(F.col("p.a"), F.col("p.b"), buckets=buckets)),
        )).alias("bucket"), "trusted",
    ).filter("bucket is not null")
    return rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))


def log_ratios(counts: DataFrame, buckets: int) -> list[float]:
    """log(target share / raw share) of each bucket, one added to each count.
    The table has at most ``buckets`` rows, whatever the corpus."""
    import math

    raw, target = [1] * buckets, [1] * buckets
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    n_raw, n_target = sum(raw), sum(target)
    return [math.log(t / n_target) - math.log(r / n_raw) for r, t in zip(raw, target)]


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = BUCKETS, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, llr.

    ``trusted`` holds the ids of target texts. base_failed: fewer than 10
    words, or repeated words above a fifth of all. kept: not base_failed and
    llr >= threshold. Null text has no words and fails; a text without
    n-grams has llr 0. Repeated rows each come out; an empty table gives an
    empty result; columns beyond those named are not read."""
    ids = trusted.select(F.col(id_col).alias("_trusted")).filter("_trusted is not null").distinct()
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one plan at every size: the trusted ids grow with the corpus and are never broadcast
    target = marked.filter("text is not null").join(ids.hint("merge"), F.col("id") == F.col("_trusted"), "left_semi")
    both = bucket_counts(marked, "text", F.lit(0), buckets).select("bucket", "raw", F.lit(0).cast("long").alias("target"))
    own = bucket_counts(target, "text", F.lit(1), buckets).select("bucket", F.lit(0).cast("long").alias("raw"), "target")
    counts = both.union(own).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # a constant that the optimizer folds into one array literal
    table = F.split(F.lit(",".join(f"{x:.17g}" for x in log_ratios(counts, buckets))), ",").cast("array<double>")
    rows = base_rules(docs, id_col, text_col)

    def ratio(ws: Column) -> Column:
        singles = F.transform(ws, lambda w: F.get(table, bucket(w, buckets=buckets)))
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(ws) - 2),
            lambda i: F.get(table, bucket(F.get(ws, i), F.get(ws, i + 1), buckets=buckets)),
        )
        add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
        total = add(singles) + F.when(F.size(ws) > 1, add(pairs)).otherwise(F.lit(0.0))
        return total / (2 * F.size(ws) - 1)

    rows = rows.withColumn("llr", F.when(F.size("words") > 0, ratio(F.col("words"))).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
