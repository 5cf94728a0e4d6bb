"""Key-value property texts ("a=1;b=2") as arrays of (k, v) structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoalgraph.functions.text import strip

KIND = "array<struct<k:string,v:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_props(c: Column) -> Column:
    """Items with "=", split at the first one, trimmed; the last of equal keys stays, in the order of first appearance by
    last value. Null, "null" and "" give no items."""
    items = F.filter(F.split(c, ";"), lambda s: s.contains("="))
    pairs = F.transform(items, lambda s: F.struct(strip(F.substring_index(s, "=", 1)).alias("k"), strip(F.substr(s, F.instr(s, "=") + 1)).alias("v")))

    def last(p: Column) -> Column:
        after = lambda i: F.slice(p, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0)))
        return F.filter(p, lambda x, i: ~F.exists(after(i), lambda y: y["k"].eqNullSafe(x["k"])))

    return F.when(c.isNull() | c.isin("", "null"), F.array().cast(KIND)).otherwise(bound(pairs, last))


def normalize_props(pairs: Column) -> Column:
    """Without values that are null, blank or "none" in any case."""
    return F.filter(pairs, lambda x: x["v"].isNotNull() & ~F.lower(strip(x["v"])).isin("", "none"))
