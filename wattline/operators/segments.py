"""Header attachment for line-tagged multi-segment feeds, by carry-forward.

A feed file holds comment lines (``C,``), header lines (``I,``) that open a
segment, and data lines (``D,``) belonging to the most recent header of the
same file (optionally of one named table). Every file may hold several
segments with different columns.

Lines in no order (rows of tables, entries of archives) meet their header by a
look-up: the headers are read first and landed, each with the key of the next
header of its file, and, if they are counted few, broadcast to the lines. A line
takes the header of its file between whose key and the next it lies, one at most.
Nothing is shuffled and no task of Python is needed.

Where lines come in the order of a scan, or a feed has more headers than that (see
:data:`HEADERS_PER_FILE`), the lines are taken in pieces, each a stretch
of one file in line order: the splits of a text scan as they come, else the
parts of a range partitioning by file and line. One pass over a piece carries
the last header forward to the lines after it, and the piece returns the header
that is open at its end. A prefix scan over these few rows (one a piece) gives
every piece the header it starts with, which its lines before their first own
header take by an equi join on the piece, a broadcast one if these are counted
small. The text is read once, split once, and its fields are landed once with their
header positions; no range join is made, whatever the number of headers, files or
lines.

Every line gets a verdict (see :data:`VERDICTS`). Fields are looked up by header
name (``get(parts, position)``), so segments with different column orders or
extra columns line up without a union, and absent columns come out NULL. Extra
cells are ignored, short rows give NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from ..functions.casts import feed_timestamp, unquote
from ..functions.text import split_fields
from ..session import DEFAULT_BROADCAST_BYTES, DEFAULT_BROADCAST_ROWS, land, land_small, row_bytes, ship_package

HEADER, DATA, SHORT, UNKNOWN, OPEN_AT_END = range(5)

#: What becomes of a line; ``used`` and ``bad time`` lines are rows of the parse.
USED, HEADLESS, REJECTED_FILE = "used", "data line before any header", "missing required columns"
SHORT_LINE, UNKNOWN_TAG, BAD_TIME = "short line", "unknown tag", "unparsed time"
VERDICTS = [USED, HEADLESS, REJECTED_FILE, SHORT_LINE, UNKNOWN_TAG, BAD_TIME]


@dataclass
class ParsedFeed:
    """Result of :func:`parse_segments`.

    ``lines``: every data, short and unknown line with its ``verdict`` (file,
    line_key, verdict, and the fields of ``rows``).
    ``rows``: one row per attached data line, a STRING column per wanted
    name plus ``file``, ``line_key``, ``segment_key``.
    ``headers``: the header table (file, segment_key, header, accepted, reason).
    """

    lines: DataFrame
    rows: DataFrame
    headers: DataFrame

    def observed(self, name: str = "verdicts") -> tuple[DataFrame, Observation]:
        """``rows``, and the totals of all verdicts, which the first action on
        ``rows`` (a write, a count) fills in passing: no pass of their own."""
        totals = Observation(name)
        counts = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS]
        seen = self.lines.observe(totals, F.count(F.lit(1)).alias("lines"), *counts)
        return _rows(seen, self.rows.columns), totals


def _rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    return lines.where(F.col("verdict").isin(USED, BAD_TIME)).select(*columns)


def _pos_col(name: str) -> str:
    return f"_pos_{name}"


#: Headers a file may have for its lines to look theirs up: a line is compared with
#: each of them. A feed with more in any file is carried forward (as is one whose
#: headers are too many to broadcast).
HEADERS_PER_FILE = 64

#: Lines that a task sorts, about: at some 400 bytes each, 200 MB.
LINES_PER_PART = 500_000


def in_pieces(lines: DataFrame, n_lines: int = 0) -> DataFrame:
    """``lines`` with ``piece``: text that ascends along a file, equal on a
    stretch of lines that one task reads in line order. Scans bring it along;
    other lines are range-partitioned by file and line and sorted, in as many
    parts as ``n_lines`` need. The number is explicit: adaptive execution folds
    parts by their compressed bytes, and feed lines unpack to many times these."""
    if "piece" in lines.columns:
        return lines
    n = max(lines.sparkSession.sparkContext.defaultParallelism, -(-n_lines // LINES_PER_PART))
    ranged = lines.repartitionByRange(n, "file", "line_key").sortWithinPartitions("file", "line_key")
    return ranged.withColumn("piece", F.lpad(F.spark_partition_id().cast("string"), 10, "0"))


def _carrier(columns: list[str], checks: list[list[str]]):
    """The pass over the lines of a task, a batch at a time: each line gets the
    key and the column positions of the last header before it in its piece
    (none: NULL). At the end of a piece comes one row of kind OPEN_AT_END with
    the last header and which ``checks`` any of its headers meets."""
    import json

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    key_type = pa.struct([("part", pa.int64()), ("pos", pa.int64())])

    def carry(batches: Iterator) -> Iterator:
        open_piece = None  # (file, piece)
        # the last header of the open piece: (part, pos, positions); what its headers meet; its last line
        last, meets, before = None, None, None

        def close(schema):
            row = {n: None for n in schema.names}
            row.update(file=open_piece[0], piece=open_piece[1], kind=OPEN_AT_END, meets=meets)
            if last is not None:
                row["segment_key"] = {"part": last[0], "pos": last[1]}
                row.update({_pos_col(c): p for c, p in zip(columns, last[2])})
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, piece = batch.column("file"), batch.column("piece")
            part, pos = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in batch.column("line_key").flatten())
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            change = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(piece[1:], piece[:-1]))
            starts = np.flatnonzero(np.concatenate(([True], change.to_numpy(zero_copy_only=False))))
            ends = np.append(starts[1:], n)
            is_header = kind == HEADER
            heads = np.flatnonzero(is_header)
            names = batch.column("header")
            found = [json.loads(names[int(i)].as_py() or "[]") for i in heads]
            positions = [[h.index(c) + 1 if c in h else 0 for c in columns] for h in found]
            met = [[any(c in h for c in check) for check in checks] for h in found]
            # rows of the table of headers: 0 none, 1 the one carried in, then this batch's
            which = np.zeros(n, np.int64)
            fields = pa.schema([*batch.schema, ("segment_key", key_type), ("meets", pa.list_(pa.bool_())),
                                *[(_pos_col(c), pa.int32()) for c in columns]])
            schema = schema or fields
            carried = last
            done = []
            for a, z in zip(starts.tolist(), ends.tolist()):
                here = (file[a].as_py(), piece[a].as_py())
                if here != open_piece:
                    if open_piece is not None:
                        done.append(close(schema))
                    open_piece, last, meets, before = here, None, [False] * len(checks), None
                keys = part[a:z], pos[a:z]
                back = (np.diff(keys[0]) < 0) | ((np.diff(keys[0]) == 0) & (np.diff(keys[1]) < 0))
                if back.any() or (before is not None and (keys[0][0], keys[1][0]) < before):
                    raise ValueError(f"lines of {here[0]} are not in order within a piece")
                before = (keys[0][-1], keys[1][-1])
                low, high = np.searchsorted(heads, [a, z])
                at = np.full(z - a, 1 if last is not None else 0)
                own = heads[low:high]
                at[own - a] = np.arange(low, high) + 2
                which[a:z] = np.maximum.accumulate(at)
                for k in range(low, high):
                    meets = [x or y for x, y in zip(meets, met[k])]
                if high > low:
                    i = int(heads[high - 1])
                    last = (int(part[i]), int(pos[i]), positions[high - 1])
            first = carried or (0, 0, [0] * len(columns))
            table = np.array([[0] * len(columns), first[2], *positions], np.int32).reshape(-1, len(columns))
            table_part = np.concatenate(([0, first[0]], part[heads]))
            table_pos = np.concatenate(([0, first[1]], pos[heads]))
            none = which == 0
            key = pa.StructArray.from_arrays(
                [pa.array(table_part[which]), pa.array(table_pos[which])], fields=list(key_type), mask=pa.array(none)
            )
            out = [*batch.columns, key, pa.nulls(n, pa.list_(pa.bool_()))]
            out += [pa.array(table[which, c], mask=none) for c in range(len(columns))]
            yield pa.RecordBatch.from_arrays(out, schema=schema)
            yield from done
        if open_piece is not None:
            yield close(schema)

    return carry


def parse_segments(
    lines: DataFrame,
    columns: list[str],
    *,
    table: str | None = None,
    contains: str | list[str] | None = None,
    require: list[str] | None = None,
    require_any: list[str] | None = None,
    time_column: str | None = None,
) -> ParsedFeed:
    """Attach data lines to their segment header and look fields up by name.

    ``table``: only header/data lines whose third field (trimmed, upper-case)
    equals it; other tables are ignored, also between a header and its rows.
    ``contains``: raw-line substring pre-filter on data lines (one unit id or
    several); an optimisation only, exact filtering happens after parsing.
    ``require``/``require_any``: per-file column check over the union of the
    file's headers; files failing it are rejected as a whole.
    ``time_column``: one of ``columns``; a row without a valid time there has the
    verdict ``unparsed time`` (and stays a row).

    Blank and comment lines are ignored. The lines that matter are landed with
    their fields when this is called.
    """
    spark = lines.sparkSession
    v = F.col("value")
    # columns riding along with each line (e.g. an explicit file order)
    extra = [c for c in lines.columns if c not in ("file", "line_key", "value", "tag", "piece")]

    # Filters test the raw text with cheap string functions; the (quote-aware)
    # split runs once, in the projection after them. Filtering on the split
    # array would make the optimizer repeat the split inside every filter.
    head3 = F.substring_index(v, ",", 3)             # tag, group, table
    tag = F.col("tag") if "tag" in lines.columns else F.upper(F.trim(F.substring_index(v, ",", 1)))
    more_than_3 = F.octet_length(head3) < F.octet_length(v)     # ≥ 3 commas → > 3 fields
    in_table = F.lit(True) if table is None else F.upper(F.trim(F.substring_index(head3, ",", -1))) == table.upper()
    wanted = in_table
    if contains:
        subs = [contains] if isinstance(contains, str) else list(contains)
        wanted = reduce(lambda a, b: a | b, [v.contains(s) for s in subs]) & in_table
    # data lines first: they are the most, and are told without the other tests
    kind = (
        F.when((tag == "D") & more_than_3 & wanted, DATA)
        .when(tag.isin("I", "D") & ~more_than_3, SHORT)
        .when((tag == "I") & in_table, HEADER)
        .when(~tag.isin("C", "I", "D", ""), UNKNOWN)
    )
    is_header = (tag == "I") & more_than_3 & in_table
    # the lines of any other kind, in as few tests
    is_judged = ((tag == "D") & (wanted | ~more_than_3)) | ((tag == "I") & ~more_than_3) | ~tag.isin("C", "I", "D", "")
    parts = split_fields(v)
    header = F.transform(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), lambda x: F.trim(unquote(x)))
    checks = [*[[c] for c in require or []], *([require_any] if require_any else [])]

    text = None
    if "piece" not in lines.columns:
        heads = lines.where(is_header)
        heads = land(heads.select("file", F.col("line_key").alias("segment_key"), header.alias("header")), "feed-headers")
        if _few(heads):
            judged = lines.where(is_judged).select("file", "line_key", "value", kind.alias("kind"), *extra)
            text, heads = _look_up(judged, heads, columns, checks, extra)
    if text is None:
        text, heads = _carry_forward(lines.withColumn("kind", kind), header, columns, checks, extra)

    verdict = (
        F.when(F.col("kind") == UNKNOWN, UNKNOWN_TAG)
        .when(F.col("kind") == SHORT, SHORT_LINE)
        .when(F.col("segment_key").isNull(), HEADLESS)
        .when(F.col("_rejected"), REJECTED_FILE)
    )
    if time_column:
        verdict = verdict.when(feed_timestamp(time_column).isNull(), BAD_TIME)
    judged = text.withColumn("verdict", verdict.otherwise(USED))
    rows = ["file", "line_key", "segment_key", *extra, *columns]
    # rows need no verdict on their time, so they do not wait for it
    used = text.where((F.col("kind") == DATA) & F.col("segment_key").isNotNull() & F.col("_rejected").isNull()).select(*rows)
    heads = heads.withColumn("reason", F.when(~F.col("accepted"), F.lit(REJECTED_FILE)))
    return ParsedFeed(lines=judged.select("verdict", *rows), rows=used, headers=heads)


def _few(heads: DataFrame) -> bool:
    """Whether the headers may be broadcast, and each line be compared with
    those of its file."""
    by_file = heads.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(heads)).alias("size"))
    n, most, size = by_file.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.max("n"), F.sum("size"))]).head()
    return n <= DEFAULT_BROADCAST_ROWS and size <= DEFAULT_BROADCAST_BYTES and most <= HEADERS_PER_FILE


def _look_up(
    lines: DataFrame, heads: DataFrame, columns: list[str], checks: list[list[str]], extra: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Lines (with ``kind``, no headers) with the fields of their header, and the
    headers: the last one before a line in its file, looked up among the few there are."""
    meets = [F.bool_or(reduce(lambda a, b: a | b, [F.array_contains("header", c) for c in check])) for check in checks]
    whole = Window.partitionBy("file")
    accepted = reduce(lambda a, b: a & b, [m.over(whole) for m in meets], F.lit(True))
    heads = land(heads.select(
        "*", accepted.alias("accepted"), F.lead("segment_key").over(whole.orderBy("segment_key", "header")).alias("_next"),
    ), "feed-starts")
    places = [F.nullif(F.array_position("header", F.lit(c)).cast("int"), F.lit(0)).alias(_pos_col(c)) for c in columns]
    starts = heads.select(
        F.col("file").alias("_of"), "segment_key", "_next", F.when(~F.col("accepted"), F.lit(True)).alias("_rejected"), *places,
    )
    # keys are compared whole: a position that is NULL is before all others
    here = F.col("file").eqNullSafe(F.col("_of")) & (F.col("line_key") > F.col("segment_key"))
    here = here & (F.col("_next").isNull() | (F.col("line_key") <= F.col("_next")))
    text = lines.join(F.broadcast(starts), here, "left")
    cells = F.when(F.col("kind") == DATA, split_fields("value")).alias("_cells")
    ahead = ["file", "line_key", "segment_key", "kind", "_rejected", *extra]
    text = text.select(*ahead, cells, *[_pos_col(c) for c in columns])
    text = text.select(*ahead, *[unquote(F.get("_cells", F.col(_pos_col(c)) + 2)).alias(c) for c in columns])
    # the fields are landed, not the text: what filters or casts them splits nothing
    # anew. A field is stored as its ``value``, as the cells of a carry-forward are
    text = text.select(*[F.struct(F.when(F.col(c) != "", F.col(c)).alias("value")).alias(c) for c in columns], *ahead)
    text = land(text, "feed-lines").select(*ahead, *[F.col(c)["value"].alias(c) for c in columns])
    return text, heads.select("file", "segment_key", "header", "accepted")


def _carry_forward(
    lines: DataFrame, header: Column, columns: list[str], checks: list[list[str]], extra: list[str]
) -> tuple[DataFrame, DataFrame]:
    """As :func:`_look_up`, for lines in the order of a scan and for any number of
    headers: piece by piece, the last header carried forward."""
    ship_package(lines.sparkSession)
    v = F.col("value")
    n_lines = 0 if "piece" in lines.columns else lines.count()
    kept = in_pieces(lines.where(F.col("kind").isNotNull()), n_lines)
    # names go to the tasks as one text: a list that is mostly NULL costs the Arrow
    # writer a pass over the batch for every row
    names = F.when(F.col("kind") == HEADER, F.to_json(header)).alias("header")
    kept = kept.select("file", "piece", "line_key", "kind", "value", names, *extra)

    schema = StructType([StructField(f.name, f.dataType, True) for f in kept.schema.fields])
    schema = schema.add("segment_key", StructType().add("part", LongType()).add("pos", LongType()))
    schema = schema.add("meets", ArrayType(BooleanType()))
    for c in columns:
        schema = schema.add(_pos_col(c), IntegerType())
    carried = kept.mapInArrow(_carrier(columns, checks), schema)
    # the fields are landed, not the text: filters on a field, which the optimizer
    # moves down to the scan, then look up a stored array and repeat no split
    cells = F.when(F.col("kind") == DATA, split_fields(v)).alias("cells")
    quoted = v.contains('"').alias("_quoted")
    rest = [c for c in carried.columns if c not in ("file", "piece", "value", "header")]
    carried = carried.select("file", "piece", cells, quoted, F.from_json("header", "array<string>").alias("header"), *rest)
    clean = F.when(F.col("_quoted"), F.transform("cells", unquote)).otherwise(F.col("cells"))
    carried = carried.withColumn("cells", F.arrays_zip(clean.alias("value"))).drop("_quoted")
    # stored by kind, so the few rows of headers and pieces are read without the text
    landed = land(carried, "feed-lines", partition_by=["kind"])

    positions = [_pos_col(c) for c in columns]
    ends = landed.where(F.col("kind") == OPEN_AT_END)
    opened = F.when(F.col("segment_key").isNotNull(), F.struct("segment_key", *positions))
    along = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file", "piece", F.last(opened, ignorenulls=True).over(along).alias("_start")).where(F.col("_start").isNotNull())
    accepted = [F.bool_or(F.get("meets", F.lit(i))) for i in range(len(checks))]
    files = ends.groupBy("file").agg(
        F.bool_or(F.col("segment_key").isNotNull()).alias("_any"),
        reduce(lambda a, b: a & b, accepted, F.lit(True)).alias("accepted"),
    )
    failing = files.where(F.col("_any") & ~F.col("accepted")).select("file", F.lit(True).alias("_rejected"))

    # a row a piece, a row a file: broadcast if counted small, so that the lines are
    # not shuffled by the few pieces and files they have
    starts = land_small(starts, "feed-starts")
    text = landed.where(F.col("kind").isin(DATA, SHORT, UNKNOWN)).join(starts, ["file", "piece"], "left")
    if checks:
        failing = land_small(failing, "feed-rejected")
        text = text.join(failing, "file", "left")
    else:
        text = text.withColumn("_rejected", F.lit(None).cast("boolean"))

    def own(name: str) -> Column:
        return F.coalesce(F.col(name), F.col(f"_start.{name}")).alias(name)

    text = text.select(
        "file", "line_key", "kind", own("segment_key"), *[own(p) for p in positions], "_rejected", "cells", *extra,
    )
    fields = []
    for c in columns:
        p = F.col(_pos_col(c))
        cell = F.get("cells", p + 2)["value"]
        fields.append(F.when((F.col("kind") == DATA) & (p > 0) & (cell != ""), cell).alias(c))
    heads = landed.where(F.col("kind") == HEADER).select("file", "segment_key", "header").join(
        files.select("file", "accepted"), "file", "left"
    )
    return text.select("file", "line_key", "segment_key", "kind", "_rejected", *extra, *fields), heads


def rejects(parsed: ParsedFeed) -> DataFrame:
    """Lines that did not become a reading: ``(file, line_key, reason)``, the
    reason being any of :data:`VERDICTS` but ``used``."""
    return parsed.lines.where(F.col("verdict") != USED).select("file", "line_key", F.col("verdict").alias("reason"))


def ingest_report(parsed: ParsedFeed, time_parsed: str | None = None) -> DataFrame:
    """Per file: rows kept, segments, whether segment schemas differ, parse rate.

    ``time_parsed`` names a typed column of ``parsed.rows`` (after casting)
    whose non-NULL share is the parse rate.
    """
    rows = parsed.rows
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("segment_key").alias("n_segments"),
    ]
    if time_parsed:
        aggs.append(F.count(time_parsed).alias("n_time_parsed"))
    rep = rows.groupBy("file").agg(*aggs)
    schemas = parsed.headers.where("accepted").groupBy("file").agg(
        (F.count_distinct(F.array_sort("header")) > 1).alias("schemas_differ")
    )
    rep = rep.join(schemas, "file", "left")
    if time_parsed:
        rep = rep.withColumn(
            "parse_rate", F.round(F.try_divide(F.col("n_time_parsed") * 100.0, F.col("n_rows")), 3)
        )
    return rep
