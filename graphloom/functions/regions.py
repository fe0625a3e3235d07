"""Regions and edge types: resolving words of a query to codes (driver side) and describing codes (columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import tokens_text


def hemisphere(region: Column) -> Column:
    return F.when(F.endswith(region, F.lit("_L")), "Left").when(F.endswith(region, F.lit("_R")), "Right").otherwise("Center")


def without_side(region: Column) -> Column:
    return F.regexp_replace(region, "_[LR]$", "")


def region_set(text: str, regions: list[dict]) -> set[str]:
    """An exact code, else codes that start so, else a hemisphere, else regions whose side and description have all the words."""
    t = text.strip().upper()
    codes = [r["region"] for r in regions]
    if t in (c.upper() for c in codes):
        return {c for c in codes if c.upper() == t}
    if t and (found := {c for c in codes if c.upper().startswith(t)}):
        return found
    if found := {r["region"] for r in regions if r["hemisphere"].upper() == t}:
        return found
    words = {w.lower() for w in tokens_text(text)}
    return {r["region"] for r in regions if words and words <= {w.lower() for w in tokens_text(f"{r['hemisphere']} {r['description']}")}}


def region_list(text: str, regions: list[dict]) -> set[str]:
    """The whole text as one lookup, else the regions of each of its tokens."""
    return region_set(text, regions) or {r for t in tokens_text(text) for r in region_set(t, regions)}


def region_or_text(text: str, regions: list[dict]) -> str:
    found = region_set(text, regions)
    return next(iter(found)) if len(found) == 1 else text


def edge_type(text: str, types: dict[str, str]) -> str:
    """A code, or the code whose name starts so, else the text."""
    t = text.strip()
    for code in types:
        if code.lower() == t.lower():
            return code
    found = [c for c, n in types.items() if t and n.lower().startswith(t.lower())]
    return found[0] if len(found) == 1 else text


def described(regions: DataFrame) -> DataFrame:
    """region and its side with its description."""
    return regions.select("region", F.concat_ws(" ", "hemisphere", "description").alias("description"))


def by_hemisphere(regions: DataFrame) -> DataFrame:
    """A JSON list of categories and their regions for each hemisphere."""
    inner = regions.groupBy("hemisphere", "category").agg(F.sort_array(F.collect_list("region")).alias("regions"))
    return inner.groupBy("hemisphere").agg(F.to_json(F.sort_array(F.collect_list(F.struct("category", "regions")))).alias("categories"))
