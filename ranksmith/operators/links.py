"""Links from texts to games, comparison of twin databases, verification counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK_RECORDS = 100_000


def name_key(c: Column) -> Column:
    """White space in a name made single and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def game_links(links: DataFrame, games: DataFrame) -> DataFrame:
    """(link_id, number): the first of the first LINK_RECORDS records whose white, black and
    event equal the link's; an empty one matches any, a link with none names nothing.

    One equi-join for each of the seven sets of given names, on those names alone, against the
    smallest number that carries them: no pair of link and game is formed beyond its match.
    """
    given = links.select("link_id", *(name_key(F.coalesce(c, F.lit(""))).alias(c) for c in ("white", "black", "event")))
    g = games.where(f"kind = 'game' AND number <= {LINK_RECORDS}").select("number", *(name_key(c).alias(c) for c in ("white", "black", "event")))
    out = None
    for mask in range(1, 8):
        cols = [c for i, c in enumerate(("white", "black", "event")) if mask >> i & 1]
        rest = [c for c in ("white", "black", "event") if c not in cols]
        some = given.where(" AND ".join([f"{c} != ''" for c in cols] + [f"{c} = ''" for c in rest]))
        low = g.groupBy(*cols).agg(F.min("number").alias("number"))
        part = some.join(low, cols).select("link_id", "number")
        out = part if out is None else out.unionByName(part)
    return out


def title_links(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(link_id, number): the first text with exactly the link's trimmed title."""
    low = texts.where("kind = 'text'").groupBy(F.trim("title").alias("_t")).agg(F.min("number").alias("number"))
    return links.join(low, F.trim(F.col("link_title")) == F.col("_t")).select("link_id", "number")


def twin_differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(number, difference): records of one side only, and the columns that differ, in order."""
    l, r = a.select("number", F.struct(*columns).alias("_a")), b.select("number", F.struct(*columns).alias("_b"))
    j = l.join(r, "number", "full_outer")
    diff = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns))), ",")
    j = j.select("number", F.when(F.col("_b").isNull(), "only left").when(F.col("_a").isNull(), "only right").otherwise(diff).alias("difference"))
    return j.where("difference != ''")


def verify_counts(records: DataFrame) -> DataFrame:
    """One row of counters over all records, in one aggregation."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s" if k != "analysis" else "analyses") for k in ("game", "text", "analysis")]
    return records.agg(
        F.count("*").alias("records"),
        *kinds,
        F.count_if("deleted").alias("deleted"),
        F.count_if("chess960").alias("chess960"),
        F.count_if(F.coalesce("eco", F.lit("")) == "").alias("no_eco"),
        F.count_if(F.contains("date_text", F.lit("?"))).alias("partial_dates"),
        F.count_if((F.col("kind") == "game") & (F.col("white_elo") <= 0) & (F.col("black_elo") <= 0)).alias("unrated"),
        F.coalesce(F.sum("moves"), F.lit(0)).cast("long").alias("full_moves"),
    )


def census(items: DataFrame, *by: str) -> DataFrame:
    """Counts of items by their columns."""
    return items.groupBy(*by).agg(F.count("*").alias("items"))
