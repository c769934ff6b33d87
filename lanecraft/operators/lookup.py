"""Search for parts of names by an index of short strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def grams(text: Column, length: Column) -> Column:
    """All different strings of ``length`` characters in a text."""
    places = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, length)))).otherwise(F.array().cast("array<string>"))


def postings(names: DataFrame, ident: str, name: str) -> DataFrame:
    """The index of ``names``: a row gram, ``ident`` for each different string of one, two or three characters in a name, in lower case."""
    lower = F.lower(name)
    every = F.flatten(F.array(*(grams(lower, F.lit(k)) for k in range(1, LONGEST + 1))))
    return names.where(F.col(name).isNotNull()).select(ident, F.explode(every).alias("gram"))


def containing(asked: DataFrame, names: DataFrame, index: DataFrame, ident: str, name: str) -> DataFrame:
    """``query`` and ``ident`` of the ``names`` that contain the ``text`` of ``asked(query, text)``, trimmed and whatever the case.

    Each text is looked up by that of its strings of three characters (fewer if it is shorter) which fewest names have; only
    the names of that posting list are tested. An empty or null text finds nothing.
    """
    wanted = asked.select("query", F.lower(F.trim("text")).alias("_text")).where("length(_text) > 0").checkpoint()
    parts = wanted.select("query", F.explode(grams(F.col("_text"), F.least(F.length("_text"), F.lit(LONGEST)))).alias("gram"))
    held = index.join(parts.select("gram").distinct(), "gram", "left_semi").checkpoint()
    # A string that no name has is the rarest of all.
    counts = parts.join(held.groupBy("gram").agg(F.count("*").alias("_n")), "gram", "left")
    rarest = counts.groupBy("query").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("r")).select("query", "r.gram")
    met = rarest.join(held, "gram").join(wanted, "query").join(names.select(ident, name), ident)
    return met.where(F.contains(F.lower(name), "_text")).select("query", ident)
