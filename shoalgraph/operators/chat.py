"""Chat log operators: entity spotting, suggestions, detail flags, response unpacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgraph import literals
from shoalgraph.functions.text import strip


def spotted(texts: DataFrame, names: list[str], column: str = "text") -> DataFrame:
    """Adds species: the first name, in sorted order, that the text contains (null if none). ``names`` is a literal list."""
    each = [F.when(F.col(column).contains(n), F.lit(n)) for n in sorted(names)]
    return texts.withColumn("species", F.coalesce(*each))


def spotted_in_either(turns: DataFrame, names: list[str], answer: str = "answer", prompt: str = "prompt") -> DataFrame:
    """The first name in the answer or, failing that, the prompt."""
    both = spotted(spotted(turns, names, answer).withColumnRenamed("species", "_a"), names, prompt)
    return both.withColumn("species", F.coalesce("_a", "species")).drop("_a")


def detail_flags(log: DataFrame) -> DataFrame:
    """Adds show_details: a query text that is neither empty nor the stand-in for none."""
    shown = F.coalesce((F.col("cypher") != literals.NO_QUERY) & (F.length(strip(F.col("cypher"))) > 0), F.lit(False))
    return log.withColumn("show_details", shown)


def unpacked(responses: DataFrame, column: str = "response") -> DataFrame:
    """query and context from a JSON response with intermediate steps, with defaults where parts are missing."""
    path = lambda p: F.get_json_object(column, p)
    query = F.coalesce(path("$.intermediate_steps[0].query"), F.lit(literals.NO_QUERY))
    context = F.coalesce(path("$.intermediate_steps[1].context"), path("$.intermediate_steps[0].context"), F.lit("[]"))
    return responses.withColumns({"cypher": query, "context": context})


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; missing optional fields are null."""
    return log.unionByName(new, allowMissingColumns=True)


def refresh_turns(log: DataFrame, species: str = "species") -> DataFrame:
    """Adds refresh: whether suggestions change at a turn (the species differs from the last turn's, or messages came)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return log.withColumn("refresh", ~F.col(species).eqNullSafe(F.lag(species).over(w)) | F.lag("turn").over(w).isNull() | (F.lag("turn").over(w) != F.col("turn")))


def changed_clicks(clicks: DataFrame, by: str, order: str) -> DataFrame:
    """Clicks at another place than the one before (the first always)."""
    w = Window.partitionBy(by).orderBy(order)
    here = F.struct("lat", "lng")
    return clicks.withColumn("_last", F.lag(here).over(w)).where(F.col("_last").isNull() | ~here.eqNullSafe(F.col("_last"))).drop("_last")


def suggestions(pool: DataFrame, last: DataFrame, seed: int = 0, n: int = 2) -> DataFrame:
    """n questions that were not suggested last time; the whole pool if fewer than n are left. The choice is by a seeded hash."""
    fresh = pool.join(last.select("label"), "label", "left_anti")
    enough = fresh.agg((F.count("*") >= n).alias("enough"))
    both = fresh.withColumn("_fresh", F.lit(True)).unionByName(pool.withColumn("_fresh", F.lit(False))).crossJoin(F.broadcast(enough))
    return both.where(F.col("_fresh") == F.col("enough")).drop("_fresh", "enough").orderBy(F.xxhash64("label", F.lit(seed)), "label").limit(n)


def random_pick(df: DataFrame, seed: int, n: int = 1) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def with_images(names: DataFrame, files: DataFrame, name: str = "species", folder: str = "images") -> DataFrame:
    """Rows whose picture (<folder>/<name>.jpg) is among the listed files (column path)."""
    have = files.select(F.regexp_extract("path", f"{folder}/([^/]+)\\.jpg$", 1).alias("_picture")).where("_picture != ''").distinct()
    return names.join(have, F.col(name) == F.col("_picture"), "left_semi")
