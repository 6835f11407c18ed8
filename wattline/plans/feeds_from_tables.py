"""Feeds derived from the driver's tables, so every operator runs on data that
grows with the tables.

The driver tables hold no market data. Roles: ``events.user_id`` → unit,
``events.ts`` → measurement time, ``events.value`` → MW, ``events.event_type``
→ quality flag; ``lineitem`` rows → dispatch intervals of supplier units.
Feed quirks (NaN, empty cells, bad text, short/long rows, quoted commas,
two header layouts per file, orphan data lines, other tables interleaved)
are injected by fixed rules on the row ids; the DuckDB oracle applies the
same rules to the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import render_feed_time
from ..functions.dates import market_day_instant, market_day_interval_end, ntz_micros, trunc_ntz
from ..session import land
from ..sources.archives import ALL_CSVS, LandedArchives, entry_id
from ..sources.lines import LINE_KEY_TYPE, line_key, lines_from_frame


def landed(df: DataFrame) -> DataFrame:
    """Write derived rows to the shared checkpoint folder and read them back.
    Downstream filters then test a stored column instead of re-running the
    rendering expression, which the optimizer repeats for every use of a text."""
    return land(df, "derived")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _micros(ts: Column) -> Column:
    return ntz_micros(ts)


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


# ---------------------------------------------------------------------------
# SCADA-shaped data from events
# ---------------------------------------------------------------------------

def event_flag_text(e: Column, event_type: Column) -> Column:
    return (
        F.when(event_type == "click", F.lit("0"))
        .when(event_type == "view", F.lit("1"))
        .when(event_type == "purchase", F.lit("2"))
        .when(event_type == "signup", F.lit("-1"))
        .when(e % 2 == 0, F.lit("3.0"))
        .otherwise(F.lit(""))
    )


def event_flag(e: Column, event_type: Column) -> Column:
    return (
        F.when(event_type == "click", F.lit(0))
        .when(event_type == "view", F.lit(1))
        .when(event_type == "purchase", F.lit(2))
        .when(event_type == "signup", F.lit(-1))
        .when(e % 2 == 0, F.lit(3))
    )


def event_mw(e: Column, value: Column) -> Column:
    return (
        F.when(e % 17 == 0, F.lit(float("nan")))
        .when(e % 19 == 0, F.lit(None).cast("double"))
        .when(e % 23 == 0, F.lit(None).cast("double"))
        .otherwise(value)
    )


def events_as_scada(events: DataFrame) -> DataFrame:
    """Typed SCADA-shaped series straight from events (no text round trip)."""
    e = F.col("event_id")
    meas = trunc_ntz("ts", "second")
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("duid"),
        trunc_ntz("ts", "minute").alias("interval_datetime"),
        meas.alias("measurement_datetime"),
        event_mw(e, F.col("value")).alias("measured_mw"),
        event_flag(e, F.col("event_type")).alias("mw_quality_flag"),
        market_day_instant(meas).alias("market_day"),
    )


def events_as_dispatch(events: DataFrame) -> DataFrame:
    """Typed dispatch-shaped series from events: the second as interval end,
    value, twice and half of it as the measures, some absent."""
    e, value, settle = F.col("event_id"), F.col("value"), trunc_ntz("ts", "second")
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("duid"),
        market_day_interval_end(settle).alias("market_day"),
        settle.alias("settlementdate"),
        value.alias("initialmw"),
        F.when(e % 3 != 0, value * 2).alias("initial_energy_storage"),
        F.when(e % 5 != 0, value / 2).alias("energy_storage"),
    )


HEADER_A = "I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,FPP_UNITID,MEASURED_MW,MW_QUALITY_FLAG"
HEADER_B = "I,FPP,FPPMW,2,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,EXTRA,MEASURED_MW,MW_QUALITY_FLAG"


def scada_feed_lines(events: DataFrame, offset: int = 0, faults: bool = False) -> DataFrame:
    """Events rendered as SCADA feed text: one file per day (which begins
    ``offset`` hours after midnight), a first-half segment (layout A, unit column
    FPP_UNITID) and a second-half segment (layout B, unit column DUID and an
    extra column). ``faults`` adds short lines, lines of an unknown tag, more
    lines before the header, and files (days divisible by five) that lack a
    required column."""
    e = F.col("event_id")
    ts = F.col("ts")
    begun = ts - F.make_dt_interval(hours=F.lit(offset))
    day = F.to_date(begun)
    file = F.concat(F.lit("scada/FEED_"), F.date_format(day, "yyyyMMdd"), F.lit(".CSV"))
    meas_txt = F.when(e % 13 == 0, F.lit("not-a-time")).otherwise(render_feed_time(ts))
    ivl_txt = render_feed_time(trunc_ntz(ts, "minute"))
    mw_txt = (
        F.when(e % 17 == 0, F.lit("NaN"))
        .when(e % 19 == 0, F.lit(""))
        .when(e % 23 == 0, F.lit("bad"))
        .otherwise(F.col("value").cast("string"))
    )
    flag_txt = event_flag_text(e, F.col("event_type"))
    duid = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    extra = F.when(e % 37 == 0, F.lit('"x,y"')).otherwise(F.concat(F.lit("x"), e.cast("string")))
    tail = F.when(e % 29 == 0, F.lit("")).otherwise(F.concat(F.lit(","), flag_txt))
    tail = F.concat(tail, F.when(e % 31 == 0, F.lit(",junk")).otherwise(F.lit("")))
    first_half = F.hour(begun) < 12
    value = F.when(
        first_half,
        F.concat_ws(",", F.lit("D,FPP,FPPMW,1"), _q(ivl_txt), _q(meas_txt), duid, mw_txt),
    ).otherwise(
        F.concat_ws(",", F.lit("D,FPP,FPPMW,2"), _q(ivl_txt), _q(meas_txt), duid, extra, mw_txt)
    )
    data = lines_from_frame(
        events,
        file,
        line_key(0, _micros(ts) * 2 + 1),
        F.concat(value, tail),
    )
    # days are told apart before their file is named: text costs more to group by
    days = events.select(day.alias("day")).distinct()
    days = days.select("day", F.concat(F.lit("scada/FEED_"), F.date_format("day", "yyyyMMdd"), F.lit(".CSV")).alias("file"))
    d0 = _micros(F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(offset)))
    d12 = _micros(F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(offset + 12)))

    def header(text: str) -> Column:
        if not faults:
            return F.lit(text)
        return F.when(F.dayofmonth("day") % 5 == 0, F.lit(text.replace("MEASURED_MW", "OTHER_MW"))).otherwise(F.lit(text))
    extra_lines = days.select(
        "file",
        F.explode(
            F.array(
                F.struct(line_key(0, d0 * 2 - 6).alias("k"), F.lit("C,synthetic feed,wattline").alias("v")),
                F.struct(line_key(0, d0 * 2 - 4).alias("k"), F.lit("D,FPP,FPPMW,1,orphan,row").alias("v")),
                F.struct(line_key(0, d0 * 2 - 2).alias("k"), F.lit("").alias("v")),
                F.struct(line_key(0, d0 * 2).alias("k"), header(HEADER_A).alias("v")),
                F.struct(line_key(0, d12 * 2).alias("k"), header(HEADER_B).alias("v")),
            )
        ).alias("x"),
    ).select("file", F.col("x.k").alias("line_key"), F.col("x.v").alias("value"))
    lines = data.unionByName(extra_lines)
    if faults:
        after, ahead = line_key(0, _micros(ts) * 2 + 2), line_key(0, _micros(day.cast("timestamp_ntz")) * 2 - 10 - e)
        wrong = F.array_compact(F.array(
            F.when(e % 41 == 0, F.struct(after.alias("k"), F.lit("D,FPP").alias("v"))),
            F.when(e % 43 == 0, F.struct(after.alias("k"), F.lit("X,FPP,FPPMW,1,odd").alias("v"))),
            F.when(e % 47 == 0, F.struct(ahead.alias("k"), value.alias("v"))),
        ))
        wrong = events.select(file.alias("file"), F.explode(wrong).alias("x"))
        lines = lines.unionByName(wrong.select("file", F.col("x.k").alias("line_key"), F.col("x.v").alias("value")))
    return landed(lines)


# ---------------------------------------------------------------------------
# Dispatch-shaped data from lineitem (+ orders as another table)
# ---------------------------------------------------------------------------

DISPATCH_HEADER = "I,DISPATCH,UNIT_SOLUTION,4,SETTLEMENTDATE,RUNNO,DUID,INITIALMW,INITIAL_ENERGY_STORAGE,ENERGY_STORAGE"
PRICE_HEADER = "I,DISPATCH,PRICE,4,SETTLEMENTDATE,RUNNO,REGIONID,RRP"


def lineitem_settlement() -> Column:
    return (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).cast("timestamp_ntz")


def lineitem_key() -> Column:
    """Line position of a lineitem row inside its file (unique enough; ties
    are broken by payload in the de-duplication order)."""
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def dispatch_feed_lines(lineitem: DataFrame, orders: DataFrame, layouts: bool = False) -> DataFrame:
    """lineitem rendered as UNIT_SOLUTION rows (one file per ship month),
    orders rendered as PRICE rows interleaved in the same files. ``layouts``: of
    four months' files, one lacks the unit column and one the storage columns."""
    settle = lineitem_settlement()
    def file_of(day: Column) -> Column:
        return F.concat(F.lit("dispatch/DISPATCH_"), F.date_format(day, "yyyyMM"), F.lit(".CSV"))

    shipped, ordered = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    tag = F.when(F.col("l_linenumber") == 3, F.lit("d")).otherwise(F.lit("D"))
    us = lineitem.select(
        file_of(shipped).alias("file"),
        line_key(1, lineitem_key()).alias("line_key"),
        F.concat_ws(
            ",",
            tag,
            F.lit("DISPATCH,UNIT_SOLUTION,4"),
            render_feed_time(settle),
            F.lit("1"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
            F.col("l_quantity").cast("string"),
            F.col("l_extendedprice").cast("string"),
            F.col("l_tax").cast("string"),
        ).alias("value"),
    )
    price = orders.select(
        file_of(ordered).alias("file"),
        line_key(1, F.col("o_orderkey") * 8 + 5).alias("line_key"),
        F.concat_ws(
            ",",
            F.lit("D,DISPATCH,PRICE,4"),
            render_feed_time(F.col("o_orderdate")),
            F.lit("1"),
            F.col("o_orderstatus"),
            F.col("o_totalprice").cast("string"),
        ).alias("value"),
    )
    # days are told apart before their file is named: text costs more to group by
    days = lineitem.select(shipped.alias("day")).distinct().union(orders.select(ordered.alias("day")).distinct())
    files = days.select(file_of(F.col("day")).alias("file")).distinct()
    header = F.lit(DISPATCH_HEADER)
    if layouts:
        month = F.regexp_extract("file", r"\d{4}(\d\d)", 1).cast("int") % 4
        header = F.when(month == 0, F.lit(DISPATCH_HEADER.replace("DUID", "UNIT"))).when(
            month == 1, F.lit(DISPATCH_HEADER.replace("INITIAL_ENERGY_STORAGE", "X").replace("ENERGY_STORAGE", "Y"))
        ).otherwise(header)
    heads = files.select(
        "file",
        F.explode(
            F.array(
                F.struct(line_key(0, 0).alias("k"), F.lit(PRICE_HEADER).alias("v")),
                F.struct(line_key(0, 1).alias("k"), header.alias("v")),
            )
        ).alias("x"),
    ).select("file", F.col("x.k").alias("line_key"), F.col("x.v").alias("value"))
    return landed(us.unionByName(price).unionByName(heads))


def lineitem_as_dispatch(lineitem: DataFrame) -> DataFrame:
    """Typed dispatch-shaped series straight from lineitem: supplier units,
    ship time + line number hours as interval end (hits 04:00 exactly),
    quantity / price / tax as the three measures. Suppliers whose key ends
    in 0 report no initial storage; line 7 reports no end storage."""
    settle = lineitem_settlement()
    return lineitem.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("duid"),
        market_day_interval_end(settle).alias("market_day"),
        settle.alias("settlementdate"),
        F.col("l_quantity").alias("initialmw"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_extendedprice")).alias("initial_energy_storage"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("energy_storage"),
    )


# ---------------------------------------------------------------------------
# Archive catalog from orders
# ---------------------------------------------------------------------------

ORDER_DATE_SHIFT_DAYS = 9862  # moves 1995-2001 order dates to 2022-2028: all eras occur


def order_settlement_date(orders: DataFrame) -> Column:
    return F.date_add(F.to_date(F.col("o_orderdate")), ORDER_DATE_SHIFT_DAYS)


def orders_catalog_paths(orders: DataFrame) -> DataFrame:
    """One landed archive path per order (bundle names repeat; distinct paths).

    Six name shapes by ``o_orderkey % 6``: SCADA daily first/second half,
    SCADA monthly/weekly bundles, dispatch daily, dispatch monthly bundle.
    Every 97th order carries an impossible month (13) in its name."""
    base = orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey"), order_settlement_date(orders).alias("d")
    )
    k, d = F.col("k"), F.col("d")
    base = base.select(
        "k", "o_custkey",
        F.when(k % 97 == 0, F.concat(F.date_format(d, "yyyy"), F.lit("13"), F.date_format(d, "dd")))
        .otherwise(F.date_format(d, "yyyyMMdd")).alias("dstr"),
        F.lpad(k.cast("string"), 16, "0").alias("seq"),
        F.date_format(F.trunc(d, "month"), "yyyyMMdd").alias("month"),
        F.date_format(F.trunc(d, "week"), "yyyyMMdd").alias("week"),
    )
    dstr, seq, month, week = F.col("dstr"), F.col("seq"), F.col("month"), F.col("week")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("PUBLIC_NEXT_DAY_FPPMW_"), dstr, F.lit("_"), seq, F.lit(".zip")))
        .when(k % 6 == 1, F.concat(F.lit("PUBLIC_NEXT_DAY_FPPMW_2_"), dstr, F.lit("040000_"), seq, F.lit(".zip")))
        .when(k % 6 == 2, F.concat(F.lit("PUBLIC_NEXT_DAY_FPPMW_"), month, F.lit(".zip")))
        .when(k % 6 == 3, F.concat(F.lit("PUBLIC_NEXT_DAY_FPPMW_2_"), week, F.lit(".zip")))
        .when(k % 6 == 4, F.concat(F.lit("PUBLIC_NEXT_DAY_DISPATCH_"), dstr, F.lit("_"), seq, F.lit(".zip")))
        .otherwise(F.concat(F.lit("PUBLIC_NEXT_DAY_DISPATCH_"), month, F.lit(".zip")))
    )
    source = F.when(F.col("o_custkey") % 3 == 0, F.lit("current")).otherwise(F.lit("archive"))
    return landed(base.select(F.concat(F.lit("/landing/"), source, F.lit("/"), name).alias("path")).distinct())


def order_targets(orders: DataFrame) -> DataFrame:
    """Requested settlement dates: every (shifted) order date."""
    return orders.select(order_settlement_date(orders).alias("target_date")).distinct()


# ---------------------------------------------------------------------------
# Unit registry sheet from customer ⨝ nation
# ---------------------------------------------------------------------------

REGION_CODES = ["QLD1", "NSW1", "VIC1", "SA1", "NT1"]  # by n_regionkey; NT1 is not a market region


def _registry_rows(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Customers joined to their region, as sheet cells plus ``_region`` and
    ``_key`` (used only for the text export)."""
    from ..session import broadcast_if_small

    nat, _ = broadcast_if_small(nation.select("n_nationkey", "n_regionkey"))
    j = customer.join(nat, customer["c_nationkey"] == nat["n_nationkey"], "inner")
    ck = F.col("c_custkey")
    region = F.element_at(F.array(*[F.lit(r) for r in REGION_CODES]), F.col("n_regionkey") + 1)
    return j.select(
        F.when(ck % 50 == 0, F.lit("")).otherwise(F.concat(F.lit(" C"), ck.cast("string"), F.lit(" "))).alias("DUID"),
        F.concat(F.lit("note "), ck.cast("string")).alias("DUID Comment"),
        F.when(ck % 7 == 0, F.lit("")).otherwise(F.col("c_name")).alias("Unit Name"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("Solar PV")).otherwise(F.lit(" Battery Storage ")).alias("Technology Type"),
        F.when(F.col("c_acctbal") > 0, F.lit("In Service")).otherwise(F.lit("Committed")).alias("Commitment Status"),
        region.alias("Region"),
        F.when(ck % 5 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("Agg Nameplate Capacity (MW AC)"),
        F.when(F.col("c_nationkey") % 4 == 0, F.lit(None).cast("string"))
        .otherwise((F.col("c_nationkey") * 10).cast("string")).alias("Agg Nameplate Storage Capacity (MWh) [3]"),
        F.col("n_regionkey").alias("_region"),
        ck.alias("_key"),
    )


def customer_registry_sheet(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Customers as rows of the generator sheet (all STRING cells, padded
    with spaces, some empty, a decoy column next to the unit id, the storage
    column named with a trailing note so it resolves by prefix)."""
    return _registry_rows(customer, nation).drop("_region", "_key")


def customer_registry_lines(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The same sheet exported as CSV text: one file per region key with
    three title rows, the header row, then one quoted line per customer."""
    rows = _registry_rows(customer, nation)
    cols = [c for c in rows.columns if not c.startswith("_")]
    file = F.concat(F.lit("registry/region_"), F.col("_region").cast("string"), F.lit(".csv"))
    quoted = [F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit('"')) for c in cols]
    data = rows.select(file.alias("file"), line_key(1, F.col("_key")).alias("line_key"),
                       F.concat_ws(",", *quoted).alias("value"))
    tops = [("Generation information,,,", 0), ("Published for tests", 1), (",,,", 2), (",".join(cols), 3)]
    heads = rows.select(file.alias("file")).distinct().select(
        "file",
        F.explode(F.array(*[F.struct(line_key(0, k).alias("k"), F.lit(v).alias("v")) for v, k in tops])).alias("x"),
    ).select("file", F.col("x.k").alias("line_key"), F.col("x.v").alias("value"))
    return landed(data.unionByName(heads))


# ---------------------------------------------------------------------------
# Request log from events
# ---------------------------------------------------------------------------

ACTION_OF_EVENT = [
    ("view", "view"),
    ("click", "download_csv"),
    ("purchase", "download_parquet"),
    ("signup", "download_energy_csv"),
    ("error", "download_energy_parquet"),
]


def events_forwarded(events: DataFrame) -> tuple[Column, Column]:
    e, u = F.col("event_id"), F.col("user_id")
    fwd = (
        F.when(e % 3 == 0, F.lit(None).cast("string"))
        .when(e % 3 == 1, F.concat(F.lit(" 10.0."), (u % 16).cast("string"), F.lit("."), (u % 7).cast("string"), F.lit(" , 172.16.0.1")))
        .otherwise(F.lit(""))
    )
    peer = F.when(e % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("192.168."), (u % 4).cast("string"), F.lit("."), (u % 9).cast("string"))
    )
    return fwd, peer


def events_as_log(events: DataFrame) -> DataFrame:
    """Events as request-log rows (id, time, client, unit, date, action,
    duration, source type)."""
    from ..functions.text import client_address
    from ..sources.requestlog import conform_log

    e, u = F.col("event_id"), F.col("user_id")
    fwd, peer = events_forwarded(events)
    action = None
    for et, act in ACTION_OF_EVENT:
        action = F.when(F.col("event_type") == et, F.lit(act)) if action is None else action.when(F.col("event_type") == et, F.lit(act))
    source = F.element_at(F.array(*[F.lit(s) for s in ("current", "archive", "dispatch_current", "dispatch_archive")]), (u % 4 + 1).cast("int"))
    return conform_log(events.select(
        e.alias("id"),
        F.col("ts").alias("timestamp"),
        client_address(fwd, peer).alias("ip"),
        F.concat(F.lit("U"), u.cast("string")).alias("duid"),
        F.to_date("ts").alias("date"),
        action.alias("action"),
        F.when(e % 11 == 0, F.lit(None)).otherwise(F.round(F.col("value") * 1000)).cast("bigint").alias("duration_ms"),
        source.alias("source_type"),
    ))



# ---------------------------------------------------------------------------
# Archives as landed tables: listing and text
# ---------------------------------------------------------------------------

SCADA_NAME, DISPATCH_NAME = "PUBLIC_NEXT_DAY_FPPMW_", "PUBLIC_NEXT_DAY_DISPATCH_"
LISTING = ["path", "outer", "inner", "size", "error"]


def _text(lines: DataFrame, listing: DataFrame) -> DataFrame:
    """``lines`` (day, line_key, value) as the text of the entries that hold their
    day (``listing`` with day and ``broken``); a broken entry has an error row."""
    entry = entry_id(F.col("path"), F.col("outer"))
    held = listing.where(F.col("error").isNull()).select(
        "day", "broken", entry.alias("entry"),
        F.when(F.col("inner").isNull(), entry).otherwise(F.concat(entry, F.lit("!/DATA.CSV"))).alias("file"),
    )
    none = F.lit(None).cast("string")
    good = lines.join(held.where(~F.col("broken")), "day").select("entry", "file", "line_key", "value", none.alias("error"))
    bad = held.where("broken").select(
        "entry", F.col("entry").alias("file"), F.lit(None).cast(LINE_KEY_TYPE).alias("line_key"), none.alias("value"),
        F.lit("bad zip: not readable").alias("error"),
    )
    return good.unionByName(bad)


def _listing(days: DataFrame, *kinds: tuple) -> DataFrame:
    """Entries of all ``days``, for each kind (condition, path, outer, in an inner
    archive, broken, error): those days that meet the condition have it."""
    nothing = F.lit(None).cast("string")
    entries = [
        F.when(cond, F.struct(
            path.alias("path"), outer.alias("outer"), (F.lit(ALL_CSVS) if packed else nothing).alias("inner"),
            F.lit(0).cast("long").alias("size"), error.alias("error"), broken.alias("broken"),
        ))
        for cond, path, outer, packed, broken, error in kinds
    ]
    listed = days.select("day", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("day", "e.*")
    return landed(listed)  # used for the entries and for every reading of text: the days are looked up once


def scada_archives(events: DataFrame, nested: bool = False) -> tuple[DataFrame, LandedArchives]:
    """The events' SCADA feed as daily archives: their paths, and the archives.

    Plain: dated CSV entries in archives of the current folder. ``nested``:
    the CSVs are in inner ZIPs, in both folders; in the current folder the
    inner ZIPs of days divisible by three are corrupt."""
    lines = scada_feed_lines(events).withColumn("day", F.regexp_extract("file", r"(\d{8})", 1)).drop("file")
    days = events.select(F.date_format("ts", "yyyyMMdd").alias("day")).distinct()
    name = F.concat(F.lit(SCADA_NAME), F.col("day"))
    never, nothing = F.lit(False), F.lit(None).cast("string")
    outer = F.concat(name, F.lit(".zip" if nested else ".CSV"))
    corrupt = F.col("day").cast("int") % 3 == 0

    def kind(folder: str, broken: Column) -> tuple:
        return F.lit(True), F.concat(F.lit(f"/landing/{folder}/"), name, F.lit("_0000000000000001.zip")), outer, nested, broken, nothing

    kinds = [kind("current", corrupt), kind("archive", never)] if nested else [kind("current", never)]
    listing = _listing(days, *kinds)
    return listing.select("path").distinct(), LandedArchives(listing.select(*LISTING), _text(lines, listing))


def scada_bundles(events: DataFrame) -> tuple[DataFrame, LandedArchives]:
    """The feed by market day, in archives named by the next day: days that
    are even have a daily archive (the sevenths with one undated CSV), and
    all others an inner archive, told by its name, in the bundle of a month."""
    lines = scada_feed_lines(events, offset=4).withColumn("day", F.regexp_extract("file", r"(\d{8})", 1)).drop("file")
    days = events.select(F.date_format(market_day_instant("ts"), "yyyyMMdd").alias("day")).distinct()
    day = F.to_date("day", "yyyyMMdd")
    published = F.date_format(F.date_add(day, 1), "yyyyMMdd")
    daily = F.concat(F.lit("/landing/current/" + SCADA_NAME), published, F.lit("_0000000000000001.zip"))
    bundle = F.concat(F.lit("/landing/archive/" + SCADA_NAME), F.substring(published, 1, 6), F.lit("01.zip"))
    dated = F.concat(F.lit(SCADA_NAME), published)
    even, never, nothing = F.dayofmonth(day) % 2 == 0, F.lit(False), F.lit(None).cast("string")
    outer = F.when(F.dayofmonth(day) % 7 == 0, F.lit("DATA.CSV")).otherwise(F.concat(dated, F.lit(".CSV")))
    listing = _listing(
        days,
        (even, daily, outer, False, never, nothing),
        (~even, bundle, F.concat(dated, F.lit("_0000000000000002.zip")), True, never, nothing),
    )
    return listing.select("path").distinct(), LandedArchives(listing.select(*LISTING), _text(lines, listing))


def dispatch_archives(lineitem: DataFrame, whole: bool = False) -> tuple[DataFrame, LandedArchives]:
    """lineitem's dispatch feed as archives by market day.

    Even days have a daily archive in the current folder: every fourth is no
    ZIP at all (multiples of eight) or holds a corrupt inner one, the sixes have
    an undated CSV, the others a dated one. The bundle of a month in the
    archive folder has the dated CSVs of all days but the multiples of five, or,
    if ``whole``, of every day."""
    settle = lineitem_settlement()
    market_day = market_day_interval_end(settle)
    data = lineitem.select(
        F.date_format(market_day, "yyyyMMdd").alias("day"),
        line_key(F.date_format(F.to_date("l_shipdate"), "yyyyMM").cast("int"), lineitem_key()).alias("line_key"),
        F.concat_ws(
            ",", F.lit("D,DISPATCH,UNIT_SOLUTION,4"), render_feed_time(settle), F.lit("1"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("string"),
            F.col("l_extendedprice").cast("string"), F.col("l_tax").cast("string"),
        ).alias("value"),
    )
    days = lineitem.select(market_day.alias("day")).distinct().select(F.date_format("day", "yyyyMMdd").alias("day"))
    heads = days.select("day", line_key(0, 0).alias("line_key"), F.lit(DISPATCH_HEADER).alias("value"))
    lines = landed(data.unionByName(heads))
    no = F.substring("day", 7, 2).cast("int")
    daily = F.concat(F.lit("/landing/current/" + DISPATCH_NAME), F.col("day"), F.lit("_0000000000000001.zip"))
    bundle = F.concat(F.lit("/landing/archive/" + DISPATCH_NAME), F.substring("day", 1, 6), F.lit("01.zip"))
    dated = F.concat(F.lit(DISPATCH_NAME), F.col("day"), F.lit(".CSV"))
    outer = F.when(no % 10 == 6, F.lit("DATA.CSV")).otherwise(dated)
    never, nothing = F.lit(False), F.lit(None).cast("string")
    listing = _listing(
        days,
        ((no % 2 == 0) & (no % 4 != 0), daily, outer, False, never, nothing),
        (no % 8 == 4, daily, F.concat(F.lit(DISPATCH_NAME), F.col("day"), F.lit(".zip")), True, F.lit(True), nothing),
        (no % 8 == 0, daily, nothing, False, never, F.lit("bad zip")),
        (F.lit(True) if whole else no % 5 != 0, bundle, dated, False, never, nothing),
    )
    return listing.select("path").distinct(), LandedArchives(listing.select(*LISTING), _text(lines, listing))
