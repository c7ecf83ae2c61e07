"""Column-to-column building blocks; all of them stay inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- predicates -------------------------------------------------------------


def has_prefix(code: Column | str, *prefixes: str) -> Column:
    """True when the code starts with any prefix; NULL stays NULL."""
    return reduce(or_, (_col(code).startswith(p) for p in prefixes))


def lacks_prefix(code: Column | str, *prefixes: str) -> Column:
    """Negated prefix test; a NULL code is dropped by a filter on it."""
    return ~has_prefix(code, *prefixes)


def mentions_word(text: Column | str, word: str) -> Column:
    """Case-insensitive whole-word test, missing text counts as no."""
    return F.coalesce(_col(text).rlike(rf"(?i)\b{word}\b"), F.lit(False))


def holds(condition: Column) -> Column:
    """A comparison with a missing operand counts as false."""
    return F.coalesce(condition, F.lit(False))


def plausible_adult(dob: str, admitted: str, age: str, lo: int = 18, hi: int = 100) -> Column:
    """Date sanity limits plus the adult age range, ends included."""
    return (
        (F.year(dob) > 1800)
        & (F.year(admitted) > 2000)
        & (F.col(admitted) > F.col(dob))
        & F.col(age).between(lo, hi)
    )


# ---- dates ------------------------------------------------------------------


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Calendar-day boundaries crossed."""
    return F.datediff(_col(later), _col(earlier))


def year_boundaries(later: Column | str, earlier: Column | str) -> Column:
    """New-year boundaries crossed, birthdays ignored."""
    return F.year(_col(later)) - F.year(_col(earlier))


def completed_years(at: Column | str, born: Column | str) -> Column:
    """Age in whole years with the birthday taken into account."""
    at, born = _col(at), _col(born)
    not_yet = F.struct(F.month(at), F.dayofmonth(at)) < F.struct(F.month(born), F.dayofmonth(born))
    return F.year(at) - F.year(born) - F.when(not_yet, 1).otherwise(0)


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Hours as a double, from whole microseconds and independent of the session time zone."""
    gap = _col(later) - _col(earlier)
    part = lambda unit: F.extract(F.lit(unit), gap)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    micros = minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")
    return micros.cast("double") / F.lit(3.6e9)


def hour_number(at: Column | str) -> Column:
    """Hours since 1970 on the wall clock; never decreases with time."""
    return F.datediff(_col(at), F.lit("1970-01-01").cast("date")) * 24 + F.hour(_col(at))


def add_hours(at: Column | str, hours: int) -> Column:
    return _col(at) + F.make_dt_interval(hours=F.lit(hours))


def parse_time(text: Column | str, fmt: str | None = None, strict: bool = False) -> Column:
    """Lenient by default (NULL on bad text); ``strict`` raises instead."""
    fmt_arg = [F.lit(fmt)] if fmt else []
    if strict:
        return F.to_timestamp_ntz(_col(text), *fmt_arg)
    return F.try_to_timestamp(_col(text), *fmt_arg).cast("timestamp_ntz")


def decade(years: Column | str) -> Column:
    return (F.floor(_col(years) / F.lit(10.0)) * 10).cast("bigint")


def age_decade(years: Column | str) -> Column:
    """Decade of age; ages shifted by 300 years for privacy become 90 and 95."""
    d = decade(years)
    return F.when(d == 300, F.lit(90)).when(d > 300, F.lit(95)).otherwise(d).cast("bigint")


def age_decade_label(years: Column | str) -> Column:
    d = decade(years)
    return (
        F.when(d == 300, "90+").when(d > 300, "95+").otherwise(F.concat(d.cast("string"), F.lit("s")))
    )


# ---- numbers ----------------------------------------------------------------


def percent_up(part: Column, whole: Column) -> Column:
    """Rounded-up percentage; NULL when the whole is zero."""
    return F.ceil(F.try_divide(part.cast("double"), whole.cast("double")) * 100).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def first_digits(text: Column | str) -> Column:
    """First run of digits as a number, NULL when there is none."""
    return F.regexp_substr(_col(text), F.lit("[0-9]+")).cast("double")


def lenient_number(text: Column | str) -> Column:
    """NULL for anything that is not a number; NaN counts as missing."""
    n = _col(text).try_cast("double")
    return F.when(~F.isnan(n), n)


def rise_percent(peak: Column | str, base: Column | str) -> Column:
    """Percentage rise over the base; 0 when the base is missing or not positive."""
    peak, base = _col(peak), _col(base)
    return F.when(base > 0, (peak - base) / base * 100).otherwise(F.lit(0.0))


def per_day(total: Column | str, hours: Column | str) -> Column:
    """Total rescaled to 24 hours; 0 when there is no positive duration."""
    total, hours = _col(total), _col(hours)
    return F.when(hours > 0, total * (F.lit(24.0) / hours)).otherwise(F.lit(0.0))


# ---- labels -----------------------------------------------------------------


def yes_no(condition: Column) -> Column:
    return F.when(condition, "YES").otherwise("NO")


def weekend_label(at: Column | str) -> Column:
    return F.when(F.weekday(_col(at)) >= 5, "Weekend").otherwise("Weekday")


def binned_right_closed(value: Column | str, edges: list[float], labels: list[str]) -> Column:
    """(e0, e1], (e1, e2], ...; NULL outside."""
    v = _col(value)
    out = F.when(v <= edges[0], F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(v <= edge, label)
    return out


def binned_left_closed(value: Column | str, edges: list[float], labels: list[str]) -> Column:
    """[e0, e1), [e1, e2), ...; NULL outside, so the top edge itself has no label."""
    v = _col(value)
    out = F.when(v < edges[0], F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(v < edge, label)
    return out


# Age bins, risk buckets, creatinine bands.
AGE_EDGES = [0, 18, 40, 65, 90, 120]
AGE_LABELS = ["0-18", "19-40", "41-65", "66-90", "90+"]
RISK_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
RISK_LABELS = ["Very Low", "Low", "Moderate", "High", "Very High"]


def age_bin(value: Column | str) -> Column:
    return binned_right_closed(value, AGE_EDGES, AGE_LABELS)


def risk_bucket(score: Column | str) -> Column:
    return binned_left_closed(score, RISK_EDGES, RISK_LABELS)


def creatinine_band(peak: Column | str) -> Column:
    """Three levels; a missing peak falls through to the last."""
    v = _col(peak)
    return (
        F.when(v < 1.2, "Normal")
        .when(v.between(1.2, 2.0), "Mildly Elevated")
        .otherwise("Severely Elevated")
    )


# ---- text and arrays --------------------------------------------------------


def strip(text: Column | str) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def first_sentence(text: Column | str) -> Column:
    return F.substring_index(_col(text), ".", 1)


def strip_prefix(text: Column, prefix: str) -> Column:
    """Drop a leading phrase, case-insensitively, and trim what follows it."""
    hit = F.lower(text).startswith(prefix.lower())
    return F.when(hit, strip(F.substring(text, len(prefix) + 1, 1 << 30))).otherwise(text)


def non_empty(*columns: str) -> Column:
    """Wide columns as an array, trimmed, without missing or blank entries."""
    return F.filter(
        F.array(*[strip(c) for c in columns]), lambda x: x.isNotNull() & (x != "")
    )


# ---- repeatable order -------------------------------------------------------


#: 13 hexadecimal digits, so that the numbers are exact as doubles too.
MIXED_END = 1 << 52


def mixed(key: Column | str, seed: int = 42) -> Column:
    """Number in [0, MIXED_END) from the md5 of seed and key (of any type), which never changes.

    The key breaks ties, so an order by (mixed, key) does not depend on partitioning.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
