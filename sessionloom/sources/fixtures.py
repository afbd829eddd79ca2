"""Market panels derived from the order tables: bars, universes, actions, filings, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# total order of trades inside one bar: first / last of it give open / close
TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
CALENDAR_START = {"week": "1995-01-02", "month": "1995-01-01"}


def session_start(ts: str | Column, grain: str) -> Column:
    return F.to_date(F.date_trunc(grain, ts))


def session_index(day: Column, grain: str) -> Column:
    """The calendar is a rule, so a session's ordinal needs no scan and no shuffle."""
    if grain == "month":
        return ((F.year(day) - 1995) * 12 + F.month(day)).cast("int")
    return (F.floor(F.datediff(day, F.lit(CALENDAR_START["week"]).cast("date")) / 7) + 1).cast("int")


def session_range(t, grain: str = "week") -> tuple[int, int]:
    """First and last session with a line item; every grid over the calendar starts and ends there. (1, 1) if there is none."""
    days = t.lineitem.agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("z"))
    a, z = days.select(*[session_index(session_start(c, grain), grain) for c in ("a", "z")]).first()
    return (1, 1) if a is None else (a, z)


def _bar_columns() -> list[Column]:
    px = (F.col("l_extendedprice") / F.col("l_quantity")).alias("px")
    trade = F.struct(*[F.col(c) for c in TRADE_ORDER])
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return [
        F.min(trade).alias("first_trade"),
        F.max(trade).alias("last_trade"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.sum(cents).alias("cents"),
        F.count(F.lit(1)).alias("trades"),
    ]


def _merge_columns() -> list[Column]:
    return [
        F.min("first_trade").alias("first_trade"),
        F.max("last_trade").alias("last_trade"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.sum("cents").alias("cents"),
        F.sum("trades").alias("trades"),
    ]


def _price(trade: str) -> Column:
    return F.col(f"{trade}.l_extendedprice") / F.col(f"{trade}.l_quantity")


def _finish(df: DataFrame, grain: str) -> DataFrame:
    return df.select(
        "instrument_id",
        "session_date",
        session_index(F.col("session_date"), grain).alias("session_ix"),
        _price("first_trade").alias("open"),
        "high",
        "low",
        _price("last_trade").alias("close"),
        "volume",
        (F.col("cents") / 100.0).alias("notional"),
        "trades",
    )


def _stock_parts(t, grain: str) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("instrument_id"), session_start("l_shipdate", grain).alias("session_date")
    ).agg(*_bar_columns())


class _Between:
    """Tables whose line items are those of a range of weekly sessions, as a filter on the stored ship date."""

    def __init__(self, t, first: int, last: int):
        self._t, self._first, self._last = t, first, last

    @property
    def lineitem(self) -> DataFrame:
        day = lambda k: F.date_add(F.lit(CALENDAR_START["week"]).cast("date"), 7 * k).cast("timestamp")
        ship = F.col("l_shipdate")
        return self._t.lineitem.where((ship >= day(self._first - 1)) & (ship < day(self._last)))

    def __getattr__(self, name: str):
        return getattr(self._t, name)


def bars_between(t, first: int, last: int, entity: str = "supplier") -> DataFrame:
    """Weekly bars of the sessions first to last; the range reaches the scan, so other days are not read."""
    return bars(_Between(t, first, last), entity).where(F.col("session_ix").between(first, last))


def bars(t, entity: str = "supplier", grain: str = "week") -> DataFrame:
    """Bars of one kind of instrument.

    supplier = stock panel, market / region = broad benchmarks, type = sector funds, brand = dense long panel.
    Region bars merge the supplier bars, so line items are reduced before they meet a dimension; market bars need none, so each task sends one row per session.
    """
    if entity == "supplier":
        return _finish(_stock_parts(t, grain), grain)
    if entity == "market":
        merged = t.lineitem.groupBy(F.lit("MARKET").alias("instrument_id"), session_start("l_shipdate", grain).alias("session_date"))
        return _finish(merged.agg(*_bar_columns()), grain)
    if entity == "region":
        home = supplier_region(t).select(F.col("s_suppkey").alias("instrument_id"), "r_name")
        merged = (
            _stock_parts(t, grain)
            .join(home, "instrument_id")
            .drop("instrument_id")
            .groupBy(F.col("r_name").alias("instrument_id"), "session_date")
        )
        return _finish(merged.agg(*_merge_columns()), grain)
    key = {"type": "p_type", "brand": "p_brand"}[entity]
    lines = t.lineitem.join(t.part.select("p_partkey", key), F.col("l_partkey") == F.col("p_partkey"))
    grouped = lines.groupBy(
        F.col(key).alias("instrument_id"), session_start("l_shipdate", grain).alias("session_date")
    )
    return _finish(grouped.agg(*_bar_columns()), grain)


def supplier_region(t) -> DataFrame:
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_name", "s_acctbal", "n_name", "r_name")
    )


def master(t) -> DataFrame:
    """Instrument master: ticker, security form, exchange, country, stable identifiers."""
    k = F.col("s_suppkey")
    return supplier_region(t).select(
        k.alias("instrument_id"),
        F.col("s_name").alias("ticker"),
        F.when(k % 5 != 0, "CS").otherwise("ADRC").alias("form"),
        F.col("r_name").alias("exchange"),
        F.col("n_name").alias("country"),
        F.col("s_acctbal").alias("acctbal"),
        (F.col("s_acctbal") > 0).alias("is_primary"),
    )


def universe(t, name: str = "primary") -> DataFrame:
    """Member ids of a named universe; primary is a subset of all."""
    s = t.supplier.where(F.col("s_acctbal") > 0) if name == "primary" else t.supplier
    return s.select(F.col("s_suppkey").alias("instrument_id"))


def splits(t) -> DataFrame:
    """Split events: one per fourth supplier, a same-date reciprocal pair on each sixteenth."""
    k = F.col("s_suppkey")
    base = t.supplier.where(k % 4 == 0).select(
        k.alias("instrument_id"),
        F.col("s_name").alias("ticker"),
        (F.lit(40) + (k * 37) % 280).cast("int").alias("effective_ix"),
        (F.lit(2) + k % 3).cast("int").alias("step"),
        (k % 8 == 0).alias("reverse"),
        (k % 16 == 0).alias("paired"),
    )
    one, up = F.lit(1), F.col("step")
    first = base.select(
        "*",
        F.when(F.col("reverse"), up).otherwise(one).alias("split_from"),
        F.when(F.col("reverse"), one).otherwise(up).alias("split_to"),
        F.lit(1).alias("seq"),
    )
    back = first.where("paired").select(
        *[c for c in base.columns],
        F.col("split_to").alias("split_from"),
        F.col("split_from").alias("split_to"),
        F.lit(2).alias("seq"),
    )
    return first.unionByName(back).select(
        F.concat_ws("-", F.lit("S"), "instrument_id", "seq").alias("action_id"),
        "instrument_id", "ticker", "effective_ix", "split_from", "split_to", "seq",
    )


def dividends(t, stock_bars: DataFrame) -> DataFrame:
    """Cash dividends for every third supplier, sized by the close of the session before."""
    k = F.col("s_suppkey")
    base = t.supplier.where(k % 3 == 0).select(
        k.alias("instrument_id"),
        (F.lit(45) + (k * 37) % 280).cast("int").alias("ex_ix"),
        (F.lit(1) + k % 40).cast("int").alias("pct"),
    )
    prior = stock_bars.select("instrument_id", (F.col("session_ix") + 1).alias("ex_ix"), "close")
    return base.join(prior, ["instrument_id", "ex_ix"]).select(
        F.concat_ws("-", F.lit("D"), "instrument_id").alias("action_id"),
        "instrument_id", "ex_ix",
        (F.col("close") * 0.01 * F.col("pct")).alias("cash"),
        F.col("close").alias("prior_close"),
    )


def filings(t) -> DataFrame:
    """Reported facts: issuer, concept, form, period end, availability clock, accession, value."""
    day = F.to_date("o_orderdate")
    return t.orders.select(
        F.col("o_custkey").alias("cik"),
        F.col("o_orderpriority").alias("concept"),
        F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q")
        .otherwise("8-K").alias("form"),
        F.date_sub(F.trunc(day, "quarter"), 1).alias("period_end"),
        (F.col("o_orderdate") + F.expr("INTERVAL 16 HOURS 5 MINUTES")).alias("available_at"),
        F.col("o_orderkey").alias("accession"),
        F.col("o_totalprice").alias("value"),
    )


def user_days(t) -> DataFrame:
    """Event stream panel: one row per user and day."""
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value")
    )
