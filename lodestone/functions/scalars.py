"""Scalar expressions: text clean-up, exact decimals, identifiers, URL parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import col

#: Input amounts: ten integer digits, eighteen decimals. Discounts: eight decimals.
AMOUNT = "decimal(28,18)"
DISCOUNT = "decimal(10,8)"
MILLION = "cast(1000000 as decimal(7,0))"


def blank_to_null(x: Column | str) -> Column:
    """Missing and empty mean the same: unknown."""
    return F.nullif(col(x), F.lit(""))


def percent_encode(x: Column | str) -> Column:
    """RFC 3986 percent-encoding of everything but unreserved characters."""
    out = F.url_encode(col(x))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def iri(kind: str, key: Column | str, base: str = "urn:lodestone:") -> Column:
    """Identifier of a resource: base, kind, encoded key."""
    return F.concat(F.lit(f"{base}{kind}/"), percent_encode(col(key).cast("string")))


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts, null and empty kept apart from each other and from absent parts."""
    marked = [F.coalesce(F.concat(F.lit("="), col(p).cast("string")), F.lit("-")) for p in parts]
    lengths = [F.concat(F.length(m).cast("string"), F.lit(":"), m) for m in marked]
    return F.sha2(F.concat(*lengths), 256)


def amount(x: Column | str) -> Column:
    """Text as an exact finite amount of zero or more, else null. Zero is a value."""
    value = col(x).cast("string").try_cast(AMOUNT)
    return F.when(value >= 0, value)


def too_large(x: Column | str) -> Column:
    """Whether a text is a number that `amount` can't hold exactly: to be counted, not lost."""
    value = col(x).cast("string").try_cast("double")
    return F.coalesce((value >= 1e10) & (value < float("inf")), F.lit(False)) & amount(x).isNull()


def per_million(x: Column) -> Column:
    """An amount a token as an amount a million tokens, exactly."""
    return (x * F.expr(MILLION)).cast("decimal(34,18)")


def discount_of(x: Column) -> Column:
    """Text of a discount as an exact number, null for none. Over 1 and what is no finite
    number are errors; a negative one is a surcharge."""
    d = x.cast("string").try_cast(DISCOUNT)
    wrong = F.when(x.isNotNull() & d.isNull(), "discount is not a finite number").when(d > 1, "discount is over 1")
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast(DISCOUNT)).otherwise(d)


def discounted(x: Column, discount: Column) -> Column:
    """x * (1 - discount), for a discount by discount_of()."""
    return (x * (F.lit(1).cast(DISCOUNT) - F.coalesce(discount, F.lit(0)).cast(DISCOUNT)).cast(DISCOUNT)).cast("decimal(38,18)")


def decimal_text(x: Column | str) -> Column:
    """Canonical text of a decimal: no exponent, no trailing zeros."""
    text = F.regexp_replace(col(x).cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"\.$", ""), r"^-?0$", "0")


def collapse_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def last_segment(x: Column | str) -> Column:
    """What follows the last slash or hash."""
    return F.element_at(F.split(col(x), "[/#]"), -1)


def url_host(x: Column | str) -> Column:
    """Lower-cased host of a URL, null if there is none."""
    return F.lower(F.try_parse_url(col(x), F.lit("HOST")))


def same_site(url: Column | str, domain: Column, path_prefix: Column | None = None) -> Column:
    """Whether a web address (http or https) has the domain as its host (or with www.) and a
    path that is the prefix or goes on below it."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    web = F.lower(F.try_parse_url(col(url), F.lit("PROTOCOL"))).isin("http", "https")
    same = web & (host == F.regexp_replace(F.lower(domain), r"^www\.", ""))
    if path_prefix is not None:
        path, want = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), F.rtrim(path_prefix, F.lit("/"))
        same = same & ((want == "") | (F.rtrim(path, F.lit("/")) == want) | path.startswith(F.concat(want, F.lit("/"))))
    return F.coalesce(same, F.lit(False))


def official_site(url: Column | str, reviewed: Column) -> Column:
    """Whether a web address lies on a reviewed site: its host and, if it has one, its path."""
    return same_site(url, url_host(reviewed), F.coalesce(F.try_parse_url(reviewed, F.lit("PATH")), F.lit("")))


def dollars(cell: Column | str, discounted_cell: bool = False) -> Column:
    """The dollar amount of a table cell: `Free` is 0, one amount is it, of two in a
    discounted cell the last; anything else is null."""
    found = F.regexp_extract_all(col(cell), F.lit(r"\$(\d+(?:\.\d+)?)"), 1)
    out = F.when(col(cell) == "Free", "0").when(F.size(found) == 1, F.get(found, F.lit(0)))
    return out.when(F.size(found) == 2, F.get(found, F.lit(1))) if discounted_cell else out


def epoch_text(x: Column | str) -> Column:
    """Epoch seconds as UTC time, null for what is no whole number."""
    return F.timestamp_seconds(col(x).cast("string").try_cast("bigint"))


def sorted_json(entries: Column) -> Column:
    """JSON text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
