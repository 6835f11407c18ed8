"""Exact dedup by skew-safe combining.

Three combining steps, each of which groups by the digest *and* the whole
normalised text, so that equality is always a comparison of full contents:

1. local: rows of one input partition (partial aggregation, before any shuffle);
2. salted: what the partitions of one salt found, by (salt, digest);
3. global: the salt winners, by digest.

A group of copies, however large, reaches step 2 as one row for each input
partition and step 3 as one row for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import attach_groups, one_row_per_key, without_spaces

SALTS = 16

_MAX_LONG = 9223372036854775807
_BASE = "100000000000000000000"  # over the number of 64-bit integers


def sha256_digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_digest,
) -> DataFrame:
    """One row per input row: id, ``keep_id`` (id of the row of its group that
    stays), ``group_size``, ``kept``, ``text_sha256``, and the ``carry``
    columns as a struct ``row``.

    Texts are equal when identical after deleting ASCII white space. The row
    with the most code points in its original text stays, then the smallest
    id. Null text counts as empty (all such rows are one group); a null id
    stays only if no row of equal length has an id, and rows that repeat an
    id and text are all marked kept. An empty table gives an empty result;
    columns beyond those named are not read, whatever their names."""
    spark = docs.sparkSession
    content = without_spaces(F.col(text_col))
    rank = (
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("decimal(38,0)") * F.lit(_BASE).cast("decimal(21,0)")
        + F.coalesce(F.lit(_MAX_LONG).cast("decimal(20,0)") - F.col(id_col).cast("decimal(20,0)") + 1, F.lit(0))
    ).cast("decimal(38,0)")
    rows = docs.select(
        (F.spark_partition_id() % salts).alias("salt"),
        content.alias("content"),
        rank.alias("rank"),
    ).select("salt", digest(F.col("content")).alias("digest"), "content", "rank")
    # local and salted: partial aggregation combines in the task, the merge by (salt, digest, content)
    salted = rows.groupBy("salt", "digest", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    # global: one row a salt is left of each group; contents that share a digest stay apart
    merged = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    )
    contents = F.count("*").over(Window.partitionBy("digest"))
    rest = F.expr(f"cast(rank % {_BASE} as decimal(20,0))")
    merged = merged.withColumn("contents", contents)
    merged = merged.select(
        "digest",
        F.when(F.col("contents") > 1, F.col("content")).alias("content"),
        F.when(rest > 0, (F.lit(_MAX_LONG).cast("decimal(20,0)") - (rest - 1))).cast("long").alias("keep_id"),
        "group_size",
    )
    # a row that finds no group is one by itself; rebalanced, so that small rows are few files
    merged = merged.filter("group_size > 1 or content is not null or keep_id is null")
    merged = land(merged.hint("rebalance"), "exact-groups")
    total = docs.count()
    members = docs.select(
        F.col(id_col).alias("id"),
        content.alias("content"),
        F.struct(*[docs[c] for c in carry]).alias("row") if carry else F.lit(None).cast("int").alias("row"),
    ).withColumn("digest", digest(F.col("content")))
    # a row's group is known by the digest where one content alone has it, else by digest and content
    if merged.filter(F.col("content").isNotNull()).isEmpty():
        members, key = members.drop("content"), F.col("digest")
    else:
        shared = merged.filter(F.col("content").isNotNull()).select("digest").distinct().withColumn("shared", F.lit(True))
        members = members.join(shared, "digest", "left")
        key = F.when(F.col("shared"), F.concat(F.col("digest"), F.lit("\0").cast("binary"), F.col("content").cast("binary"))).otherwise(F.col("digest"))
    members = members.withColumn("key", key).drop("content", "shared")
    groups = merged.select(
        F.when(F.col("content").isNotNull(), F.concat(F.col("digest"), F.lit("\0").cast("binary"), F.col("content").cast("binary")))
        .otherwise(F.col("digest")).alias("key"),
        F.struct("keep_id", "group_size").alias("found"),
        F.col("group_size").alias("size"),
    )
    spread = F.concat(F.lit("-").cast("binary"), F.coalesce(F.col("id"), F.lit(0)).cast("string").cast("binary"))
    out = attach_groups(members, "key", groups, "size", ["found"], spread, total)
    single = F.col("found").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("found.keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("found.group_size")).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["row"] if carry else []),
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of equal
    texts stays. Of a group's rows that repeat the id that stays (or have none,
    where none has one), the longest text stays, then the least by all columns;
    rows that share an id alone are not copies."""
    found = exact_dedup(docs, id_col, text_col, carry=tuple(docs.columns)).filter("kept")
    found = found.select(F.col(id_col).alias("id"), "text_sha256", "row")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    return one_row_per_key(found, ["id", "text_sha256"], "row", -F.length(text), text)
