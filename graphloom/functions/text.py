"""Text functions: the tokenizer and what displays and checks values. ``*_text`` functions work on the driver, others on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate tokens, and what else becomes a space after them, in this order (fixed values).
DELIMITERS = '=-,?!;:/()[]"&'
PAIRS = ("' ", " '", ". ")
#: Words that stand for a missing value (fixed values).
SENTINELS = ("", "na", "nan", "none", "null", "nil", "unknown", "undefined", "unspecified", "unassigned", "unavailable")


def tokens_text(text: str) -> list[str]:
    text = (text or "").translate({ord(c): " " for c in DELIMITERS})
    for p in PAIRS:
        text = text.replace(p, " ")
    return [t for t in (re.sub(r"^[.']", "", re.sub(r"[.']$", "", x)) for x in text.split()) if t]


def tokens(text: Column) -> Column:
    """Split at delimiters and white space, one leading and one trailing point or quote off, no empty ones."""
    text = F.translate(F.coalesce(text, F.lit("")), DELIMITERS, " " * len(DELIMITERS))
    for p in PAIRS:
        text = F.replace(text, F.lit(p), F.lit(" "))
    return F.filter(F.transform(F.split(text, r"(?U)\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, "[.']$", ""), "^[.']", "")), lambda t: t != "")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def web_safe(text: Column) -> Column:
    """White space to spaces, quotes to back quotes."""
    return F.regexp_replace(F.regexp_replace(text, r"\s", " "), "['\"]", "`")


def title_case(text: Column) -> Column:
    """Underscores to spaces; a letter behind anything but a letter in upper case, others in lower case."""
    words = F.regexp_extract_all(F.lower(F.translate(text, "_", " ")), F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def shown(value: Column) -> Column:
    """A group's value as it is displayed: missing ones are Unknown, others in title case."""
    missing = value.isNull() | F.lower(value).isin(*SENTINELS)
    return F.when(missing, F.lit("Unknown")).otherwise(title_case(value))


def with_commas(number: Column) -> Column:
    return F.format_number(number.cast("decimal(38,0)"), 0)


def significant(number: Column, digits: int = 3) -> Column:
    """A number for display: whole from 10 on, else to so many significant digits; a double."""
    magnitude = F.when(number <= 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(number))))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - magnitude)
    return F.when(number >= 10, F.rint(number)).when(number <= 0, number).otherwise(F.rint(number * scale) / scale)


def percentage(part: Column, whole: Column) -> Column:
    """Whole percent, cut off, from 0 to 100; of at least one."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(100 * part / F.greatest(whole, F.lit(1))))).cast("int")


def truncated(text: Column, limit: int, with_length: bool = False) -> Column:
    """At most ``limit`` characters, the last two of a longer text being points; its length may follow."""
    tail = F.concat(F.lit("..("), F.length(text).cast("string"), F.lit(")")) if with_length else F.lit("..")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 2), tail)).otherwise(text)


def long_tokens_trimmed(text: Column, limit: int = 50) -> Column:
    """Tokens longer than ``limit`` get an ellipsis, in texts longer than it."""
    short = F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 5), F.lit("..."))).otherwise(t)), " ")
    return F.when(F.length(text) > limit, short).otherwise(text)


def bulleted(labels: Column, mark: str = "&nbsp; <b>&#x2022;</b> &nbsp; ") -> Column:
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit(mark), long_tokens_trimmed(x))), "<br>")


def is_annotation(text: Column) -> Column:
    """Has a letter from a to z and is no sentinel."""
    return F.coalesce(F.lower(text).rlike("[a-z]") & ~F.lower(text).isin(*SENTINELS), F.lit(False))


def looks_like_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^72\d{16}$"), F.lit(False))


def links(text: Column) -> Column:
    """The addresses in a label, each once; DOI and ontology ids behind a space or comma count as addresses."""
    spaced = F.translate(text, "[]()", "    ")
    doi = F.regexp_replace(spaced, r"(?i)[\s,](doi:\s?|doi\.org/?)", " https://doi.org/")
    ids = F.regexp_replace(doi, r"(?i)[\s,]FBbt([:_]| ?(?=0))", " http://flybase.org/reports/FBbt:")
    return F.array_distinct(F.transform(F.regexp_extract_all(ids, F.lit(r"(?i)(https?://[^\s]+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\.$", "")))


def by_largest_value(m: Column) -> Column:
    """A map's entries as text, largest value first, then by key."""
    entries = F.array_sort(F.map_entries(m), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string"))), ", ")


def by_key(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string"))), ", ")


def counts_for_display(m: Column) -> Column:
    """A map of maps of whole numbers with the numbers as text with commas."""
    return F.transform_values(m, lambda _, inner: F.transform_values(inner, lambda _, n: with_commas(n)))


def micros(nanos: Column, degree: int = 1) -> Column:
    """Nanometres to the given power as rounded micrometres with their unit; halves to even."""
    value = F.bround(nanos.cast("decimal(38,0)") / F.lit(1000**degree).cast("decimal(38,0)"), 0)
    return F.concat(with_commas(value), F.lit(" &#181;m" + (f"<sup>{degree}</sup>" if degree > 1 else "")))


def voxel(position: Column) -> Column:
    """``[x y z]`` in nanometres as whole 4 x 4 x 40 voxels, halves to even."""
    n = F.transform(F.filter(F.split(F.translate(position, "[],", "   "), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    size = F.array(F.lit(4.0), F.lit(4.0), F.lit(40.0))
    return F.transform(F.zip_with(n, size, lambda a, b: a / b), lambda x: F.bround(x).cast("bigint"))


DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: Column) -> Column:
    """A non-negative whole number in base 62."""
    powers = [62**i for i in range(10, -1, -1)]
    digits = F.array(*[F.floor(F.try_divide(number.cast("decimal(38,0)"), F.lit(p).cast("decimal(38,0)"))).cast("decimal(38,0)") % 62 for p in powers])
    text = F.array_join(F.transform(digits, lambda d: F.substring(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))), "")
    return F.when(number == 0, F.lit("0")).otherwise(F.regexp_replace(text, "^0+", ""))


def from_base62(text: Column) -> Column:
    chars, number = F.filter(F.split(text, ""), lambda c: c != ""), "decimal(38,0)"
    value = F.aggregate(chars, F.lit(0).cast(number), lambda s, c: (s * F.lit(62).cast(number) + (F.position(c, F.lit(DIGITS)) - 1).cast(number)).cast(number))
    return value.cast("bigint")
