"""Node labels from names and relations, as Catalyst expressions over the lists in literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoalgraph import literals
from shoalgraph.functions.text import any_of, ends_with, strip

GEO_BOTH = ["CONTAINS", "INTERSECTS", "ADJACENT_TO", "SPREAD_RISK_TO"]


def geo_label(name: Column) -> Column:
    """Label of a place: by the first list of endings that fits, then by habitat hints, else Origin; Entity for no name."""
    bare = strip(name)
    out = F.when(name.isNull() | (name == ""), "Entity")
    for found, endings in literals.PLACE_ENDINGS:
        out = out.when(ends_with(bare, endings), found)
    return out.when(any_of(bare, literals.HABITAT_HINTS), "Habitat").otherwise("Origin")


def _mode(rel: Column) -> Column:
    return F.coalesce(F.upper(strip(rel)), F.lit(""))


def source_label(name: Column, rel: Column) -> Column:
    r = _mode(rel)
    event = r.isin("AFTER", "BEFORE", "OVERLAPS", "LEADS_TO", "CAUSES") & any_of(name, literals.SOURCE_EVENT_WORDS)
    return (
        F.when(r == "MITIGATES", "Control")
        .when((r == "DURING") | event, "Event")
        .when(r == "EVENT", "Entity")
        .when(r.isin("LOCATED_IN", *GEO_BOTH), geo_label(name))
        .otherwise("Species")
    )


def default_target(rel: Column) -> Column:
    """Map look-up; Entity for relations that the map lacks."""
    pairs = [F.lit(x) for pair in literals.RELATIONS for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rel), F.lit("Entity"))


def target_label(name: Column, rel: Column) -> Column:
    r, place = _mode(rel), geo_label(name)
    event = any_of(name, literals.TARGET_EVENT_WORDS)
    return (
        F.when(r.isin("LOCATED_IN", "NATIVE_TO", *GEO_BOTH), place)
        .when(r == "REPORTED_IN", F.when(place.isin("Province", "City", "District"), place).otherwise("Province"))
        .when(r == "MITIGATES", F.when(event, "Event").otherwise("Species"))
        .when(r == "CAUSES", F.when(event, "Event").otherwise("Impact"))
        .otherwise(default_target(r))
    )
