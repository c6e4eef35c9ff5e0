"""Scalar functions on event fields."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsquant.functions import hosts
from newsquant.schema import STOP_WORDS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_day(text) -> Column:
    """`yyyyMMdd` text to a date, NULL when malformed."""
    return F.to_date(F.try_to_timestamp(_c(text), F.lit("yyyyMMdd")))


def parse_mixed_date(text) -> Column:
    """ISO or US `M/d/yyyy` text to a date, NULL when neither."""
    c = _c(text)
    iso = F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    us = F.to_date(F.try_to_timestamp(c, F.lit("M/d/yyyy")))
    return F.coalesce(iso, us)


def days_since_published(event_day, pub_day) -> Column:
    """Event day minus publication day; negative for past events."""
    return F.datediff(_c(event_day), _c(pub_day))


def days_since_epoch(day) -> Column:
    return F.unix_date(_c(day))


def is_verbal(quad_class) -> Column:
    return _c(quad_class).isin(1, 3).cast("int")


def is_cooperative(quad_class) -> Column:
    return _c(quad_class).isin(1, 2).cast("int")


def empty_to_null(text) -> Column:
    c = _c(text)
    return F.when(c != "", c)


def zero_if_empty(text) -> Column:
    """Text default used by exports: empty or NULL becomes `"0"`."""
    return F.coalesce(empty_to_null(text), F.lit("0"))


def clean_name(name, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-case, split on white space, drop stop words, join by one blank."""
    words = F.split(F.trim(F.lower(_c(name))), r"\s+")
    stops = F.array(*[F.lit(w) for w in stop_words])
    kept = F.filter(words, lambda w: (w != "") & ~F.array_contains(stops, w))
    return F.array_join(kept, " ")


def empty_fields(columns: Sequence) -> Column:
    """Number of empty or NULL fields among `columns`."""
    total = F.lit(0)
    for c in columns:
        total = total + (F.coalesce(_c(c).cast("string"), F.lit("")) == "").cast("int")
    return total


def well_formed(columns: Sequence, max_empty: int = 5) -> Column:
    return empty_fields(columns) <= max_empty


def url_host(url) -> Column:
    return hosts.url_host(_c(url))


def url_domain(url, rules=tuple(hosts.RULES)) -> Column:
    """The label left of the public suffix of a URL's host."""
    return hosts.registered_domain(_c(url), rules)


def contains_keyword(text, keyword: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(_c(text)), F.lit(keyword.lower()))


def quad_impact(quad_class) -> Column:
    """Signed weight: cooperation 1, 2 stays positive; conflict 3, 4 becomes -1, -2."""
    q = _c(quad_class)
    return F.when(q.isin(3, 4), F.lit(2) - q).otherwise(q)


def impact(kind: str, attention, goldstein, avg_tone, quad_class) -> Column:
    """Impact of an event: normalised attention times one of three scales."""
    scale = {"h1": _c(goldstein), "h2": _c(avg_tone), "h3": quad_impact(quad_class)}[kind]
    return _c(attention) * scale


def distinct_types(columns: Sequence) -> Column:
    """Distinct non-empty type codes of one actor; a single empty code if none."""
    codes = F.array_distinct(F.array_remove(F.array_compact(F.array(*[_c(c) for c in columns])), ""))
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("")))


def impact_column_name(country, type_code, value) -> Column:
    """`<country>_<type or 'empty'>_pos|neg`; zero counts as negative."""
    code = F.when(_c(type_code) == "", F.lit("empty")).otherwise(_c(type_code))
    return F.concat_ws("_", _c(country), code, F.when(_c(value) > 0, "pos").otherwise("neg"))


def sign_label(x) -> Column:
    return (_c(x) > 0).cast("int")


def band_label(x, threshold: float = 0.005) -> Column:
    """+1 above the band, -1 below it, NULL inside."""
    c = _c(x)
    return F.when(c > threshold, F.lit(1)).when(c < -threshold, F.lit(-1))


def one_hot_index(code, size: int, missing: str = "zero") -> Column:
    """0-based slot of a 1-based code; NULL means the zero vector.

    `missing='last'` reproduces the wrap-around of code 0 to the last slot.
    """
    number = F.expr(f"try_cast({code} AS INT)") if isinstance(code, str) else code
    inside = F.when(number.between(1, size), number - 1)
    if missing == "last":
        return F.when(number == 0, F.lit(size - 1)).otherwise(inside)
    return inside
