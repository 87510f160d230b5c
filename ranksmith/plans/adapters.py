"""The driver's tables as records and as lines of positions, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import date_text, round_text
from ..operators.search import Database

EVENT_TYPES = ("click", "error", "purchase", "view")


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tpch(spark, sf_dir: str) -> Database:
    """Orders as records: customers and suppliers are players, parts tournaments, nations
    annotators. Orders without lines are texts, one in 97 an analysis."""
    k = F.col("o_orderkey")
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("sk"), F.min("l_partkey").alias("pk"))
    o = _t(spark, sf_dir, "orders").join(li, k == F.col("l_orderkey"), "left")
    cust = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_c"), "c_acctbal", "c_nationkey")
    supp = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_s"), "s_acctbal")
    o = o.join(cust, F.col("o_custkey") == F.col("_c"), "left").join(supp, F.col("sk") == F.col("_s"), "left")
    kind = F.when(F.col("n").isNull(), "text").when(k % 97 == 0, "analysis").otherwise("game")
    game, text = kind == "game", kind == "text"
    elo = lambda c: F.when(game & (F.col(c) > 0), 1000 + F.floor(F.col(c) / 5)).otherwise(0).cast("int")
    y = F.when(text | (k % 31 == 0), 0).otherwise(F.year("o_orderdate"))
    m = F.when((y == 0) | (k % 29 == 0), 0).otherwise(F.month("o_orderdate"))
    d = F.when((m == 0) | (k % 11 == 0), 0).otherwise(F.dayofmonth("o_orderdate"))
    rnd, sub = F.when(game, k % 9).otherwise(0).cast("int"), F.when(game & (k % 9 > 0), k % 4).otherwise(0).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1").otherwise("1/2-1/2")
    eco = F.concat(F.chr((65 + k % 5).cast("long")), F.lpad(((k * 7) % 100).cast("string"), 2, "0"))
    records = o.select(
        (k + 1).cast("int").alias("number"),
        kind.alias("kind"),
        (k % 53 == 0).alias("deleted"),
        (k % 61 == 0).alias("chess960"),
        F.when(game, F.col("o_custkey") * 2).alias("white_id"),
        F.when(game, F.col("sk") * 2 + 1).alias("black_id"),
        F.when(game, F.col("pk")).alias("tournament_id"),
        F.when((k % 3 == 0) | ~game, F.col("c_nationkey").cast("long")).alias("annotator_id"),
        F.when(~game, F.concat(F.lit("Essay "), (k % 13).cast("string"))).alias("title"),
        F.when(~game | (k % 19 == 0), "*").otherwise(status).alias("result"),
        F.when(game & (k % 23 != 0), eco).alias("eco"),
        y.cast("int").alias("y"),
        m.cast("int").alias("m"),
        d.cast("int").alias("d"),
        date_text(y, m, d).alias("date_text"),
        rnd.alias("round"),
        sub.alias("subround"),
        round_text(rnd, sub).alias("round_text"),
        elo("c_acctbal").alias("white_elo"),
        elo("s_acctbal").alias("black_elo"),
        F.when(text, 0).otherwise(F.col("n") * 8 + k % 8).cast("int").alias("moves"),
        F.lit(None).cast("int").alias("own_time_control"),
    )
    players = _t(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"))
    players = players.unionByName(_t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_name").alias("name")))
    size = F.col("p_size")
    bits = F.when(size % 10 == 0, 0x60).when(size % 4 == 1, 0x20).when(size % 4 == 2, 0x40).when(size % 4 == 3, 0x80).otherwise(0)
    tournaments = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("place"), bits.cast("int").alias("kind"))
    annotators = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return Database(records, players, tournaments, annotators)


REC = """li AS (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS sk, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey),
o AS (SELECT *, CASE WHEN n IS NULL THEN 'text' WHEN o_orderkey % 97 = 0 THEN 'analysis' ELSE 'game' END AS kind, o_orderkey AS k
      FROM orders LEFT JOIN li ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON sk = s_suppkey),
o1 AS (SELECT *, CASE WHEN kind = 'text' OR k % 31 = 0 THEN 0 ELSE year(o_orderdate) END AS y FROM o),
o2 AS (SELECT *, CASE WHEN y = 0 OR k % 29 = 0 THEN 0 ELSE month(o_orderdate) END AS m FROM o1),
o3 AS (SELECT *, CASE WHEN m = 0 OR k % 11 = 0 THEN 0 ELSE day(o_orderdate) END AS d,
         CASE WHEN kind = 'game' THEN k % 9 ELSE 0 END AS round, CASE WHEN kind = 'game' AND k % 9 > 0 THEN k % 4 ELSE 0 END AS subround FROM o2),
rec AS (
  SELECT (k + 1)::INT AS number, kind, k % 53 = 0 AS deleted, k % 61 = 0 AS chess960,
    CASE WHEN kind = 'game' THEN coalesce(c_name, '') ELSE '' END AS white,
    CASE WHEN kind = 'game' THEN coalesce(s_name, '') ELSE '' END AS black,
    CASE WHEN kind = 'game' THEN coalesce(p_name, '') ELSE 'Essay ' || (k % 13) END AS event,
    CASE WHEN k % 3 = 0 OR kind <> 'game' THEN coalesce(n_name, '') ELSE '' END AS annotator,
    CASE WHEN kind <> 'game' OR k % 19 = 0 THEN '*' WHEN o_orderstatus = 'F' THEN '1-0' WHEN o_orderstatus = 'O' THEN '0-1' ELSE '1/2-1/2' END AS result,
    CASE WHEN kind = 'game' AND k % 23 <> 0 THEN chr((65 + k % 5)::INT) || lpad(((k * 7) % 100)::VARCHAR, 2, '0') ELSE '' END AS eco,
    y::INT AS y, m::INT AS m, d::INT AS d,
    (CASE WHEN y > 0 THEN lpad(y::VARCHAR, 4, '0') ELSE '????' END) || '.' || (CASE WHEN m > 0 THEN lpad(m::VARCHAR, 2, '0') ELSE '??' END)
      || '.' || (CASE WHEN d > 0 THEN lpad(d::VARCHAR, 2, '0') ELSE '??' END) AS date_text,
    round::INT AS round, subround::INT AS subround,
    CASE WHEN round <= 0 THEN '' WHEN subround > 0 THEN round || '(' || subround || ')' ELSE round::VARCHAR END AS round_text,
    CASE WHEN kind = 'game' AND c_acctbal > 0 THEN 1000 + floor(c_acctbal / 5) ELSE 0 END::INT AS white_elo,
    CASE WHEN kind = 'game' AND s_acctbal > 0 THEN 1000 + floor(s_acctbal / 5) ELSE 0 END::INT AS black_elo,
    CASE WHEN kind = 'text' THEN 0 ELSE n * 8 + k % 8 END::INT AS moves,
    CASE WHEN kind <> 'game' THEN 0 WHEN p_size % 10 = 0 THEN 96 WHEN p_size % 4 = 1 THEN 32 WHEN p_size % 4 = 2 THEN 64 WHEN p_size % 4 = 3 THEN 128 ELSE 0 END AS tc
  FROM o3 LEFT JOIN part ON pk = p_partkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def sequences(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(games, plies) of the event stream: a user is a game, an event a move, and a position the
    parities of the event types so far, so that positions recur within a game."""
    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    key = F.lit(0)
    for i, t in enumerate(EVENT_TYPES):
        odd = F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).over(w) % 2
        key = key + odd * (1 << i)
    after = e.select(F.col("user_id").cast("int").alias("number"), F.row_number().over(w).cast("int").alias("ply"), key.cast("long").alias("pos_key"), F.lead("event_type").over(w).alias("move"))
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("f"))
    start = first.select(F.col("user_id").cast("int").alias("number"), F.lit(0).alias("ply"), F.lit(0).cast("long").alias("pos_key"), F.col("f.event_type").alias("move"))
    games = first.select(F.col("user_id").cast("int").alias("number"))
    n, h = F.col("number"), F.md5(F.col("number").cast("string"))
    draw = lambda i, m: F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int") % m
    games = games.select(
        n,
        F.when(draw(0, 13) == 0, "text").otherwise("game").alias("kind"),
        (draw(1, 17) == 0).alias("deleted"),
        (draw(2, 29) == 0).alias("chess960"),
        F.element_at(F.array(*map(F.lit, ("white", "draw", "black", "other"))), draw(3, 4) + 1).alias("outcome"),
        F.when(draw(4, 7) == 0, 0).otherwise(1400 + draw(4, 1420)).cast("int").alias("white_elo"),
        F.when(draw(5, 6) == 0, 0).otherwise(1400 + draw(5, 1420)).cast("int").alias("black_elo"),
        (1985 + draw(6, 39)).cast("int").alias("y"),
        draw(7, 14).cast("int").alias("m"),
        (draw(7, 1000) % 32).cast("int").alias("d"),
    )
    return games, start.unionByName(after)


SEQ = """e AS (SELECT user_id::INT AS number, event_type, row_number() OVER w AS ply, lead(event_type) OVER w AS move,
         sum((event_type = 'click')::INT) OVER w AS c0, sum((event_type = 'error')::INT) OVER w AS c1,
         sum((event_type = 'purchase')::INT) OVER w AS c2, sum((event_type = 'view')::INT) OVER w AS c3
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
plies AS (
  SELECT number, ply::INT AS ply, (c0 % 2 + 2 * (c1 % 2) + 4 * (c2 % 2) + 8 * (c3 % 2))::BIGINT AS pos_key, move FROM e
  UNION ALL SELECT number, 0, 0, event_type FROM e WHERE ply = 1),
dice AS (SELECT DISTINCT number, list_transform(range(8), lambda i: ('0x' || substr(md5(number::VARCHAR), 4 * i::INT + 1, 4))::INT) AS h FROM e),
every AS (
  SELECT number, CASE WHEN h[1] % 13 = 0 THEN 'text' ELSE 'game' END AS kind, h[2] % 17 = 0 AS deleted, h[3] % 29 = 0 AS chess960,
    CASE h[4] % 4 WHEN 0 THEN 'white' WHEN 1 THEN 'draw' WHEN 2 THEN 'black' ELSE 'other' END AS outcome,
    CASE WHEN h[5] % 7 = 0 THEN 0 ELSE 1400 + h[5] % 1420 END AS white_elo,
    CASE WHEN h[6] % 6 = 0 THEN 0 ELSE 1400 + h[6] % 1420 END AS black_elo,
    1985 + h[7] % 39 AS y, h[8] % 14 AS m, h[8] % 1000 % 32 AS d FROM dice),
games AS (SELECT * FROM every WHERE kind = 'game' AND NOT deleted AND NOT chess960),
lines AS (SELECT p.* FROM plies p JOIN games USING (number)),
visits AS (SELECT number, pos_key, min(ply) AS ply, arg_min(coalesce(move, '-'), ply) AS move FROM lines GROUP BY ALL)"""


def boards(plies: DataFrame) -> DataFrame:
    """plies with made-up pieces: a position is its key and its ply modulo 16, and each board has
    one square by a multiple of that number and at times a second one. A square may have several."""
    from ..operators.fragment import BOARDS, structure

    key = F.col("pos_key") * 16 + F.col("ply") % 16
    out = plies.select("number", "ply", key.alias("pos_key"))
    for i, board in enumerate(BOARDS):
        k = "pos_key"
        out = out.withColumn(board, F.expr(f"shiftleft(1L, int(({k} * 7 + {11 * i}) % 63)) | ((({k} >> {4 + i % 4}) & 1) * shiftleft(1L, int(({k} * {2 * i + 3} + {5 * i}) % 63)))"))
    return out.withColumn("structure", structure())


_BOARDS = ", ".join(
    f"(1::BIGINT << ((pos_key * 7 + {11 * i}) % 63)::INT) | (((pos_key >> {4 + i % 4}) & 1) * (1::BIGINT << ((pos_key * {2 * i + 3} + {5 * i}) % 63)::INT)) AS {side + kind}"
    for i, (side, kind) in enumerate((side, kind) for side in "wb" for kind in "pnbrqk")
)
#: Continues SEQ.
PIECES = f""",
k AS (SELECT number, ply, pos_key * 16 + ply % 16 AS pos_key FROM lines),
b AS (SELECT number, ply, pos_key, {_BOARDS} FROM k)"""
