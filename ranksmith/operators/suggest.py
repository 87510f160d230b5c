"""Names with the number of games that carry them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import Database, resolved

ROLES = {"player": ("white", "black"), "event": ("event",), "annotator": ("annotator",)}


def name_counts(db: Database, field: str) -> DataFrame:
    """(name, games): a game counts once for a name even if both players carry it."""
    cols = ROLES[field]
    games = resolved(db, set(cols)).where("kind = 'game'")
    names = games.select(F.explode(F.array_distinct(F.array(*cols))).alias("name")) if len(cols) > 1 else games.select(F.col(cols[0]).alias("name"))
    return names.where("name != ''").groupBy("name").agg(F.count("*").alias("games"))


def suggest(db: Database, field: str, prefix: str, limit: int = 20) -> DataFrame:
    """(name, games, rank) of names that start with prefix, or whose given name does."""
    low = F.lower(F.lit(prefix))
    name = F.lower("name")
    hit = F.startswith(name, low)
    if field != "event":
        given = F.ltrim(F.substring_index(name, ",", -1))
        hit = hit | (F.contains(name, F.lit(",")) & F.startswith(given, low))
    found = name_counts(db, field).where(hit & ~F.contains("name", F.lit('"')) & (F.length("name") <= 256))
    top = found.orderBy(F.col("games").desc(), name, "name").limit(min(limit, 20))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("games").desc(), F.lower("name"), "name")).cast("long"))


def name_groups(names: DataFrame) -> DataFrame:
    """(name, group, ids): ids of one exact name share a group, its smallest id."""
    return names.where("name != ''").groupBy("name").agg(F.min("id").alias("group"), F.count("*").alias("ids"))


def name_ranks(*names: DataFrame) -> DataFrame:
    """(name, rank) over all tables: names equal but for case share a rank, the empty one is 0."""
    every = names[0].select("name")
    for n in names[1:]:
        every = every.union(n.select("name"))
    every = every.distinct()
    rank = F.dense_rank().over(Window.orderBy(F.lower("name"))).cast("long")
    known = every.where("name != ''").withColumn("rank", rank)
    return known.unionByName(every.where("name = ''").withColumn("rank", F.lit(0).cast("long")))
