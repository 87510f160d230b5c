"""Position statistics over first visits (W1-W8, A2-A6, A14, A15, J4, J6, J7,
P21, P27, P29, P30, R6, U4).

plies(number, ply, pos_key, move): ply 0 is the start, move is what was played from there and
null at a line's end. games(number, outcome, white_elo, black_elo, y, m, d, ...): outcome is
white, draw, black or other. A game counts for a position once, at its first visit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 12
#: (years back from the anchor, least rating sum) of the tiers of featured games, best first.
TIERS = ((1, 5400), (3, 5200), (5, 4800))


#: Longest move record that is indexed, in bytes.
MAX_RECORD = 2 << 20


def eligible(games: DataFrame) -> DataFrame:
    """Games that are indexed; where the source tells, only those with a readable move record
    (`readable`) of at most MAX_RECORD bytes (`record_bytes`)."""
    games = games.where("kind = 'game' AND NOT deleted AND NOT chess960")
    if "readable" in games.columns:
        games = games.where("readable")
    return games.where(F.col("record_bytes") <= MAX_RECORD) if "record_bytes" in games.columns else games


def plies_of(lines: DataFrame, key: str = "number", at: tuple[str, ...] = ("ply",), move: str = "move") -> DataFrame:
    """lines(number, ply, pos_key reached by the move before) with the move played next."""
    return lines.withColumn("move", F.lead(move).over(Window.partitionBy(key).orderBy(*at)))


def visits(plies: DataFrame, max_ply: int | None = None) -> DataFrame:
    """(number, pos_key, ply, move): the lowest ply of each game and position. A partial
    aggregation, so a position that a third of all plies reach costs one row a game and task."""
    if max_ply is not None:
        plies = plies.where(F.col("ply") <= max_ply)
    first = plies.groupBy("number", "pos_key").agg(F.min(F.struct("ply", "move")).alias("v"))
    return first.select("number", "pos_key", F.col("v.ply").alias("ply"), F.col("v.move").alias("move"))


def visits_of_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """First visits of lines (number, keys array, moves array, one shorter): a position counts
    where its index is the first of its key. Lines are whole rows, so nothing is shuffled.
    keep: columns of the game that ride along (outcome, rating, tier, total)."""
    each = lines.select("number", *keep, "keys", "moves", F.posexplode("keys").alias("ply", "pos_key"))
    each = each.where(F.array_position("keys", F.col("pos_key")) == F.col("ply") + 1)
    return each.select("number", "pos_key", F.col("ply").cast("int").alias("ply"), F.get("moves", F.col("ply")).alias("move"), *keep)


def index_visits(lines: DataFrame, games: DataFrame, all_games: DataFrame) -> DataFrame:
    """The visits artefact: first visits with all that the explorer's answers need of a game, so
    that counts, moves and both top lists are one aggregation each, without a join."""
    return visits_of_lines(lines.join(carried(games, all_games), "number"), "outcome", "rating", "tier", "total")


def carried(games: DataFrame, all_games: DataFrame) -> DataFrame:
    """(number, outcome, rating, tier, total): what a visit carries of its game."""
    g, total = games.crossJoin(F.broadcast(anchor(all_games))), rating_sum()  # one row
    return g.select("number", "outcome", average_rating().alias("rating"), tier(calendar_day(), total, F.col("anchor")).cast("int").alias("tier"), total.cast("int").alias("total"))


def with_games(visited: DataFrame, games: DataFrame | None, *columns: str) -> DataFrame:
    """visited with columns of its games, joined unless it carries them."""
    if games is None or set(columns) <= set(visited.columns):
        return visited
    return visited.join(games.select("number", *columns), "number")


def _counts() -> list[Column]:
    return [F.count("*").alias("games"), *(F.count_if(F.col("outcome") == o).alias(f"{o}s" if o == "draw" else o) for o in ("white", "draw", "black"))]


def position_counts(visited: DataFrame, games: DataFrame | None = None) -> DataFrame:
    return with_games(visited, games, "outcome").groupBy("pos_key").agg(*_counts())


def merge_counts(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Counts are additive: parts of a collection are merged by summing."""
    return a.unionByName(b).groupBy(*(keys or ("pos_key",))).agg(*(F.sum(c).alias(c) for c in ("games", "white", "draws", "black")))


def move_counts(visited: DataFrame, games: DataFrame | None = None, code: Column | None = None) -> DataFrame:
    """Per position and move of the first visit, in order: games descending, then the move's code
    (an answer of the index), or without one the smallest game number (an answer narrowed to
    some games). A game that ends at a position adds no move."""
    m = with_games(visited.where("move IS NOT NULL"), games, "outcome")
    m = m.groupBy("pos_key", "move").agg(*_counts(), F.min("number").alias("first_number"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("pos_key").orderBy(F.col("games").desc(), F.col("first_number") if code is None else code)).cast("long"))


def average_rating() -> Column:
    w, b = F.greatest("white_elo", F.lit(0)), F.greatest("black_elo", F.lit(0))
    return F.least(F.when((w > 0) & (b > 0), F.floor((w + b) / 2)).otherwise(w + b), F.lit(4095)).cast("int")


def _top(scored: DataFrame, *by: Column) -> DataFrame:
    """The first TOP of each position: ranked in the tasks that hold the visits, and what is
    left of each (at most TOP rows a task and position) again after the shuffle."""
    w = Window.partitionBy("pos_key").orderBy(*by, F.col("number").desc())
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= TOP)


def top_games(visited: DataFrame, games: DataFrame | None = None) -> DataFrame:
    """(pos_key, rank, number, rating): average rating descending, then number descending."""
    if "rating" not in visited.columns:
        visited = visited.select("number", "pos_key").join(games.select("number", average_rating().alias("rating")), "number")
    return _top(visited.select("pos_key", "number", "rating"), F.col("rating").desc()).select("pos_key", "rank", "number", "rating")


def rating_sum() -> Column:
    rating = lambda c: F.when(F.col(c) <= 0, 1500).otherwise(F.col(c))
    return F.least(rating("white_elo") + rating("black_elo"), F.lit(131070))


def calendar_day() -> Column:
    """yyyymmdd of y, m, d with unknown month or day as 1; null where there is no such day."""
    text = F.format_string("%04d-%02d-%02d", "y", F.when(F.col("m") > 0, F.col("m")).otherwise(1), F.when(F.col("d") > 0, F.col("d")).otherwise(1))
    return F.try_to_date(F.when(F.col("y") > 0, text))


def anchor(games: DataFrame) -> DataFrame:
    """One row: the newest valid day of all games not deleted, whatever else they are."""
    return games.where("kind = 'game' AND NOT deleted").agg(F.max(calendar_day()).alias("anchor"))


def tier(day: Column, total: Column, newest: Column) -> Column:
    out = F.lit(0)
    for i, (years, least) in enumerate(reversed(TIERS), 1):
        out = F.when((day >= F.add_months(newest, -12 * years)) & (total >= least), F.lit(i)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def featured_games(visited: DataFrame, games: DataFrame | None = None, all_games: DataFrame | None = None) -> DataFrame:
    """(pos_key, rank, number, tier, total): tier, then rating sum (unknown 1500), then number,
    all descending. The anchor is one row and is joined by broadcast."""
    if "tier" not in visited.columns:
        g = games.crossJoin(F.broadcast(anchor(all_games)))
        scored = g.select("number", tier(calendar_day(), rating_sum(), F.col("anchor")).cast("int").alias("tier"), rating_sum().cast("int").alias("total"))
        visited = visited.select("number", "pos_key").join(scored, "number")
    found = _top(visited.select("pos_key", "number", "tier", "total"), F.col("tier").desc(), F.col("total").desc())
    return found.select("pos_key", "rank", "number", "tier", "total")


def games_of_position(plies: DataFrame, key) -> DataFrame:
    """(number, ply): games that reach the position, and where first."""
    return plies.where(F.col("pos_key") == F.lit(key)).groupBy("number").agg(F.min("ply").alias("ply"))


def batch_lookup(visited: DataFrame, games: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts of many positions at once; a target that no game reaches has none."""
    found = position_counts(visited.join(targets.select("pos_key").distinct(), "pos_key", "left_semi"), games)
    return targets.select("pos_key").distinct().join(found, "pos_key", "left").fillna(0, ["games", "white", "draws", "black"])


def structures(plies: DataFrame, structure: Column, past: int = 20) -> DataFrame:
    """(number, structure, ply): stretches of one structure beyond a ply, each once."""
    w = Window.partitionBy("number").orderBy("ply")
    s = plies.where(F.col("ply") > past).withColumn("structure", structure)
    return s.withColumn("_b", F.lag("structure").over(w)).where("_b IS NULL OR _b != structure").select("number", "structure", "ply")


def departures(plies: DataFrame, bits: Column) -> DataFrame:
    """(number, departed): the order in which the bits of the start leave, as bit numbers."""
    w = Window.partitionBy("number").orderBy("ply")
    s = plies.withColumn("_k", bits)
    gone = s.withColumn("_gone", F.lag("_k").over(w).bitwiseAND(F.bitwise_not("_k"))).where("_gone != 0")
    each = gone.select("number", "ply", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), "_gone").where(F.getbit("_gone", F.col("bit")) == 1)
    first = each.groupBy("number", "bit").agg(F.min("ply").alias("ply"))
    return first.groupBy("number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ply", "bit"))), lambda x: x["bit"].cast("string")), " ").alias("departed"))


def allows(departed: Column, home: int, width: int = 16) -> Column:
    """Whether a line that lost its home pawns in this order (an array of bit numbers) can reach
    a position whose home pawns are `home`: the first it lost are exactly those that home lacks."""
    missing = [i for i in range(width) if not home >> i & 1]
    if not missing:
        return F.lit(True)
    return F.sort_array(F.slice(departed, 1, len(missing))) == F.array(*map(F.lit, missing))


def structure_buckets(plies: DataFrame) -> DataFrame:
    """(structure, number): which games hold a structure, each once. plies has `structure`."""
    return plies.select("structure", "number").distinct()


def games_by_structure(plies: DataFrame, buckets: DataFrame, targets: DataFrame) -> DataFrame:
    """(pos_key, number, ply): games that reach the targets (pos_key, structure) and where first.
    Candidates are the games of the target's bucket; only their lines are compared by key."""
    candidates = targets.select("pos_key", "structure").distinct().join(buckets, "structure").select("pos_key", "number")
    return plies.join(candidates, ["number", "pos_key"]).groupBy("pos_key", "number").agg(F.min("ply").alias("ply"))


def acknowledged(members: DataFrame, found: DataFrame) -> DataFrame:
    """One row: games of the position or fragment before the search, and the total with it."""
    kept = found.select("number", F.lit(True).alias("_kept"))
    return members.select("number").join(kept, "number", "left").agg(F.count("*").alias("games"), F.count_if("_kept").alias("total"))
