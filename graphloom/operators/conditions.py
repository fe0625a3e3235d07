"""Conditions on node attributes as columns: ``g.nodes.where(equal(g, "class", "x"))``.

Names are those of :mod:`graphloom.model`, aliases included, in any case. An array attribute answers if one of its values does.
Values of the edge type and region attributes may be codes or what they stand for. Comparisons are in lower case unless
``case_sensitive``; a missing value answers no condition, so it answers every negated one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.regions import edge_type, region_list, region_or_text
from graphloom.functions.text import tokens_text
from graphloom.model import Attribute, Graph
from graphloom.plans.language import attribute


def _fold(c: Column, case_sensitive: bool) -> Column:
    return c.cast("string") if case_sensitive else F.lower(c.cast("string"))


def _value(g: Graph, a: Attribute, v: str, case_sensitive: bool) -> str:
    if a.convert == "edge_type":
        v = edge_type(v, g.edge_types)
    elif a.convert == "region":
        v = region_or_text(v, g.regions)
    elif a.kind in ("long", "double"):
        v = v.replace(",", "") if v.replace(",", "").lstrip("-").isdigit() else v
    return v if case_sensitive else v.lower()


def _any(a: Attribute, test: Callable[[Column], Column], case_sensitive: bool) -> Column:
    if a.kind == "array":
        return F.coalesce(F.exists(a.column(), lambda x: test(_fold(x, case_sensitive))), F.lit(False))
    return F.coalesce(test(_fold(a.column(), case_sensitive)), F.lit(False))


def has(g: Graph, name: str, case_sensitive: bool = False) -> Column:
    """The attribute is there: not null, empty or 0."""
    return attribute(name).present()


def lacks(g: Graph, name: str, case_sensitive: bool = False) -> Column:
    return ~has(g, name)


def equal(g: Graph, name: str, value: str, case_sensitive: bool = False) -> Column:
    a = attribute(name)
    return _any(a, lambda x: x == F.lit(_value(g, a, value, case_sensitive)), case_sensitive)


def not_equal(g: Graph, name: str, value: str, case_sensitive: bool = False) -> Column:
    return ~equal(g, name, value, case_sensitive)


def starts_with(g: Graph, name: str, value: str, case_sensitive: bool = False) -> Column:
    a = attribute(name)
    return _any(a, lambda x: x.startswith(F.lit(_value(g, a, value, case_sensitive))), case_sensitive)


def contains(g: Graph, name: str, value: str, case_sensitive: bool = False) -> Column:
    a = attribute(name)
    return _any(a, lambda x: x.contains(F.lit(_value(g, a, value, case_sensitive))), case_sensitive)


def not_contains(g: Graph, name: str, value: str, case_sensitive: bool = False) -> Column:
    return ~contains(g, name, value, case_sensitive)


def is_in(g: Graph, name: str, values: str | list[str], case_sensitive: bool = False) -> Column:
    """One of a list, or of a text's tokens; a name of several regions stands for all of them."""
    a = attribute(name)
    if isinstance(values, str) and a.convert == "region" and (found := region_list(values, g.regions)):
        items = [r if case_sensitive else r.lower() for r in sorted(found)]
    else:
        items = [_value(g, a, x, case_sensitive) for x in (tokens_text(values) if isinstance(values, str) else values)]
    return _any(a, lambda x: x.isin(*items), case_sensitive) if items else F.lit(False)


def not_in(g: Graph, name: str, values: str | list[str], case_sensitive: bool = False) -> Column:
    return ~is_in(g, name, values, case_sensitive)
