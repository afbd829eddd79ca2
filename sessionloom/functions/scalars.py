"""Scalar expressions: clocks, identifiers, hashes, costs, text (SCA-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: marker patterns searched in filing text, HTML entities decoded to text
MARKERS = {"merger": r"(?i)\bmerger\b", "the_word": r"(?i)\bthe\b", "digits": r"[0-9]+", "iso_date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"}
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def session_date_of_millis(ms: Column, zone: str = "America/New_York") -> Column:
    """SCA-13: epoch milliseconds to the market-zone session date."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def age_bucket(days: Column) -> Column:
    """SCA-14."""
    return (F.when(days <= 120, "0-120").when(days <= 240, "121-240").when(days <= 450, "241-450").when(days <= 730, "451-730").otherwise("731+"))


def identifier(x: Column) -> Column:
    """SCA-15: trimmed upper-case identifier, empty becomes null."""
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID: SHA-1 of namespace bytes and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def ticker_ok(x: Column) -> Column:
    """SCA-16."""
    return x.rlike("^[A-Z0-9.-]+$")


def ratio_text(x: Column) -> Column:
    """SCA-17: "a:b" as a number; null when malformed or b is zero."""
    a = F.expr("1")
    parts = F.split(x, ":")
    a, b = parts.getItem(0).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & (b != 0), a / b)


def right_of_last_colon(x: Column) -> Column:
    return F.substring_index(x, ":", -1)


def distribution_text(x: Column) -> list[Column]:
    """SCA-18: cash, bonus and capitalisation per share from a "per 10 shares" sentence."""
    def per_share(pattern):
        return F.coalesce(F.regexp_extract(x, pattern, 1).try_cast("double"), F.lit(0.0)) / 10

    return [per_share("派([0-9.]+)元").alias("cash"), per_share("送([0-9.]+)股").alias("bonus"), per_share("转([0-9.]+)股").alias("capitalisation")]


def marker_counts(text: Column) -> list[Column]:
    """SCA-19: occurrences of each registered marker in the whole text."""
    return [F.regexp_count(text, F.lit(p)).cast("bigint").alias(k) for k, p in MARKERS.items()]


def marker_context(text: Column, pattern: str, width: int) -> Column:
    """Text around the first hit, ``width`` characters each side."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(text, start, F.lit(2 * width)))


def visible_text(html: Column) -> Column:
    """SRC-17: drop script / style / comments / tags, decode common entities, collapse white space."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\r\n\f]+", " "))


def impact_cost_bps(vol: Column, participation: Column, p: dict) -> Column:
    """SCA-07: square-root impact plus commission, half spread and delay, in basis points."""
    return p["coefficient"] * vol * F.sqrt(participation) * 1e4 + p["commission"] + p["half_spread"] + p["delay"]


def local_cost(amount: Column, side: Column, r: dict) -> list[Column]:
    """SCA-08: minimum commission, fees and stamp duty in cents, half-up; products are decimals, so ties are ties."""
    exact = amount.cast("decimal(18,2)")
    cents = lambda rate: F.round(exact * F.lit(str(rate)).cast("decimal(10,8)"), 2).cast("double")
    comm = F.greatest(cents(f"{r['commission']:.8f}"), F.lit(float(r["minimum"])))
    transfer, handling = cents(f"{r['transfer']:.8f}"), cents(f"{r['handling']:.8f}")
    stamp = F.when(side == "sell", cents(f"{r['stamp']:.8f}")).otherwise(0.0)
    return [comm.alias("commission"), transfer.alias("transfer"), handling.alias("handling"), stamp.alias("stamp"), (comm + transfer + handling + stamp).alias("total")]


def price_limits(pre_close: Column, ratio: Column) -> list[Column]:
    """SCA-09: limit-up and limit-down price in cents, half-up on decimals."""
    close, part = F.round(pre_close, 2).cast("decimal(18,2)"), F.round(ratio, 4).cast("decimal(6,4)")
    one = F.lit("1.0000").cast("decimal(6,4)")
    return [F.round(close * (one + part), 2).cast("double").alias("limit_up"), F.round(close * (one - part), 2).cast("double").alias("limit_down")]


def ex_right_reference(close: Column, cash: Column, rights_price: Column, rights_ratio: Column, bonus: Column) -> Column:
    """SCA-10."""
    return (close - cash + rights_price * rights_ratio) / (1 + rights_ratio + bonus)


def factor_reconcile(observed: Column, expected: Column, tolerance: float) -> Column:
    """SCA-06: exact / within_tolerance / mismatch / not_comparable."""
    return (F.when(observed.isNull() | expected.isNull() | (expected == 0), "not_comparable").when(observed == expected, "exact")
            .when(F.abs(observed / expected - 1) <= tolerance, "within_tolerance").otherwise("mismatch"))


def strict_decimal(text: Column) -> Column:
    """SCA-24: finite decimal text only."""
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))


def json_value_kind(text: Column, path: str) -> Column:
    """SCA-23: missing / int / decimal / text of one path."""
    v = F.get_json_object(text, path)
    return F.when(v.isNull(), "missing").when(v.rlike(r"^-?[0-9]+$"), "int").when(v.rlike(r"^-?[0-9]*\.[0-9]+$"), "decimal").otherwise("text")
