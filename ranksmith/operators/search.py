"""Records joined with their dimensions, searched, sorted and listed (S2-S4, J1-J5, R8, R1, R2, R7,
O1-O12, U1-U3, A1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import grammar
from ..plans.predicates import needs, predicate

MAX_LIMIT, DEFAULT_LIMIT, CLIP = 500, 200, 200


@dataclass
class Database:
    """records has ids of its dimensions; a text or an analysis has its title in `title` and
    its author as annotator_id. players and annotators: (id, name); tournaments: (id, title,
    place, kind), kind being the time-control bits."""

    records: DataFrame
    players: DataFrame
    tournaments: DataFrame
    annotators: DataFrame


def resolved(db: Database, wanted: set[str]) -> DataFrame:
    """records with the wanted ones of white, black, event, annotator and tc. Only their
    dimensions are joined; a missing name is empty. Join strategies are left to the planner,
    which broadcasts a dimension only where its size allows."""
    r = db.records
    game = F.col("kind") == "game"
    for role in ("white", "black"):
        if role in wanted:
            d = db.players.select(F.col("id").alias(f"_{role}"), F.col("name").alias(role))
            r = r.join(d, F.col(f"{role}_id") == F.col(f"_{role}"), "left").drop(f"_{role}")
            r = r.withColumn(role, F.when(game, F.coalesce(role, F.lit(""))).otherwise(""))
    if wanted & {"event", "tc"}:
        d = db.tournaments.select(F.col("id").alias("_t"), F.col("title").alias("_title"), F.col("kind").alias("_kind"))
        r = r.join(d, F.col("tournament_id") == F.col("_t"), "left")
        r = r.withColumn("event", F.coalesce(F.when(game, F.col("_title")).otherwise(F.col("title")), F.lit("")))
        r = r.withColumn("tc", F.coalesce("own_time_control", "_kind", F.lit(0))).drop("_t", "_title", "_kind")
    if "annotator" in wanted:
        d = db.annotators.select(F.col("id").alias("_a"), F.col("name").alias("annotator"))
        r = r.join(d, F.col("annotator_id") == F.col("_a"), "left").drop("_a")
        r = r.withColumn("annotator", F.coalesce("annotator", F.lit("")))
    return r


def sort_columns(key: str) -> list[Column]:
    """What a key orders by: unknown is 0 or empty and so comes first."""
    games_only = lambda c, unknown: F.when(F.col("kind") == "game", c).otherwise(unknown)
    if key in ("white", "black"):
        return [games_only(F.lower(F.col(key)), F.lit(""))]
    if key in ("event", "annotator"):
        return [F.lower(F.col(key))]
    if key in ("white_elo", "black_elo"):
        return [games_only(F.greatest(F.col(key), F.lit(0)), F.lit(0))]
    if key == "result":
        return [games_only(F.col("result"), F.lit("*"))]
    if key == "eco":
        return [games_only(F.coalesce("eco", F.lit("")), F.lit(""))]
    if key == "moves":
        return [F.when(F.col("kind") != "text", F.col("moves")).otherwise(0)]
    if key == "date":
        return [F.when(F.col("kind") != "text", F.col(c)).otherwise(0) for c in ("y", "m", "d")]
    if key == "round":
        known = F.col("round") > 0
        return [games_only(F.when(known, F.col("round")).otherwise(0), F.lit(0)), games_only(F.when(known & (F.col("subround") > 0), F.col("subround")).otherwise(0), F.lit(0))]
    return []


def order(key: str, descending: bool) -> list[Column]:
    """Ties go by number, ascending both ways."""
    if key == "number":
        return [F.col("number").desc() if descending else F.col("number").asc()]
    return [c.desc() if descending else c.asc() for c in sort_columns(key)] + [F.col("number").asc()]


def search(db: Database, text: str = "", sort: str | None = None, wanted: set[str] = frozenset(), members: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """(matching records, order). members: numbers that the result is confined to."""
    q = grammar.parse(text)
    if sort is not None:
        q.sort = grammar.sort_key(sort)
        if q.sort is None:
            raise grammar.BadRequest("sort")
    found = resolved(db, needs(q) | set(wanted)).where(predicate(q))
    if members is not None:
        found = found.join(members.select("number").distinct(), "number", "left_semi")
    return found, order(*(q.sort or ("number", False)))


def ranked(found: DataFrame, by: list[Column]) -> DataFrame:
    """With `rank` from 1. The window is for results that are listed whole; window() is the
    way to a page."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long"))


def window(found: DataFrame, by: list[Column], offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page: a take-ordered, not a sort of everything."""
    if not 1 <= limit <= MAX_LIMIT:
        raise grammar.BadRequest("limit")
    if offset < 0:
        raise grammar.BadRequest("offset")
    return found.orderBy(*by).offset(offset).limit(limit)


def clipped(c: Column) -> Column:
    return F.when(F.length(c) > CLIP, F.concat(F.left(c, F.lit(CLIP)), F.lit("…"))).otherwise(c)


def rows(found: DataFrame) -> DataFrame:
    """List rows of resolved records: texts and analyses have no players, result `*`, and an
    analysis keeps its date and moves."""
    game, dated = F.col("kind") == "game", F.col("kind") != "text"
    return found.select(
        "number",
        "kind",
        "deleted",
        "chess960",
        *(clipped(F.col(c)).alias(c) for c in ("white", "black", "event", "annotator")),
        F.when(game, F.col("result")).otherwise("*").alias("result"),
        F.when(game, F.coalesce("eco", F.lit(""))).otherwise("").alias("eco"),
        F.when(dated, F.col("date_text")).otherwise("????.??.??").alias("date"),
        F.when(game, F.col("round_text")).otherwise("").alias("round"),
        *(F.when(game, F.greatest(F.col(c), F.lit(0))).otherwise(0).alias(c) for c in ("white_elo", "black_elo")),
        F.when(dated, F.col("moves")).otherwise(0).alias("moves"),
    )


#: Widths of a head's fields: those of any record, and those of games.
HEAD = {"annotator_id": "int"}
GAME_HEAD = {"white_id": "int", "black_id": "int", "tournament_id": "int", "white_elo": "smallint", "black_elo": "smallint", "round": "smallint", "subround": "smallint"}


def heads(records: DataFrame) -> DataFrame:
    """The slim projection of records that a pass over all of them reads, with `fits`: whether
    every value of the record's kind fits its field and reads back the same. A collection with
    a record that does not is searched over its full records."""
    game, dated = F.col("kind") == "game", F.col("kind") != "text"
    slim = lambda c, t: F.col(c).try_cast(t)
    same = lambda c, t: slim(c, t).eqNullSafe(F.col(c))
    fits = same("moves", "smallint") | ~dated
    for c, t in HEAD.items():
        fits = fits & same(c, t)
    for c, t in GAME_HEAD.items():
        fits = fits & (same(c, t) | ~game)
    return records.select("number", "kind", "deleted", *(slim(c, t).alias(c) for c, t in (HEAD | GAME_HEAD | {"moves": "smallint"}).items()), "y", "m", "d", "eco", "result", fits.alias("fits"))
