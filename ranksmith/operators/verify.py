"""Verification of replayed lines and counts of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import Database, rows

FAILURES = 50


def info(db: Database) -> DataFrame:
    """One row: records, players, tournaments and annotators."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(db.records, "records")
    for df, name in ((db.players, "players"), (db.tournaments, "tournaments"), (db.annotators, "annotators")):
        out = out.crossJoin(F.broadcast(n(df, name)))  # one row each
    return out


def line_counts(lines: DataFrame) -> DataFrame:
    """Counters over lines (number, start_fen, ucis, sans, complete), in one aggregation."""
    count = lambda f: F.coalesce(F.sum(F.size(F.filter("sans", f))), F.lit(0)).cast("long")
    return lines.agg(
        F.count("*").alias("games"),
        F.count_if(F.col("start_fen").isNotNull()).alias("setups"),
        F.coalesce(F.sum(F.size("ucis")), F.lit(0)).cast("long").alias("plies"),
        count(lambda s: F.startswith(s, F.lit("O-O"))).alias("castlings"),
        count(lambda s: F.contains(s, F.lit("="))).alias("promotions"),
        count(lambda s: F.contains(s, F.lit("=")) & F.contains(s, F.lit("x"))).alias("promotion_captures"),
        count(lambda s: F.endswith(s, F.lit("#"))).alias("mates"),
        F.count_if(~F.col("complete")).alias("failures"),
    )


def failures(lines: DataFrame, limit: int = FAILURES) -> DataFrame:
    """The first games whose line could not be read whole, and the ply where it ends."""
    return lines.where("NOT complete").select("number", F.size("ucis").alias("ply")).orderBy("number").limit(limit)


#: States of a listed database, in the order in which they are reported.
STATES = ("ready", "opening", "missing", "cloudOnly", "downloading", "unsupported", "unreadable")


def state_counts(databases: DataFrame) -> DataFrame:
    """One row: how many databases are in each state."""
    return databases.agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))


def latencies(times: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, median, p95, max): the values at places n // 2 and n * 95 // 100 in order, from
    0. Values are counted first, so that only distinct ones are put in order. Nulls are left out."""
    each = times.where(F.col(value).isNotNull()).groupBy(label, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(label)
    each = each.withColumn("_to", F.sum("_c").over(w.orderBy(value))).withColumn("n", F.sum("_c").over(w))
    at = lambda place: F.min(F.when(F.col("_to") > place, F.col(value)))
    n = F.col("n")
    return each.groupBy(label, "n").agg(at(F.floor(n / 2)).alias("median"), at(F.floor(n * 95 / 100)).alias("p95"), F.max(value).alias("max"))


def json_rows(found: DataFrame) -> DataFrame:
    """List rows as JSON objects."""
    r = rows(found)
    return r.select("number", F.to_json(F.struct(*r.columns)).alias("json"))
