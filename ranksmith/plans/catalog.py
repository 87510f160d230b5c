"""The engine's queries over the driver's tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chess, scalars, signs
from ..operators import explorer, fragment, links, search, suggest, verify
from ..sources import databases, pgn, synthetic
from . import adapters
from .adapters import PIECES, REC, SEQ
from .store import stored

LISTED = {"white", "black", "event", "annotator"}


def _db(spark, sf_dir: str) -> search.Database:
    db = adapters.tpch(spark, sf_dir)
    made = db.records
    db.records = stored(spark, sf_dir, "records", ("orders", "lineitem", "customer", "supplier"), lambda: made, ("number",))
    return db


def _search(text: str, spark, sf_dir: str) -> DataFrame:
    found, _ = search.search(_db(spark, sf_dir), text)
    return found.select("number")


def _sorted(text: str, spark, sf_dir: str) -> DataFrame:
    return search.ranked(*search.search(_db(spark, sf_dir), text)).select("number", "rank")


def _rec(where: str, select: str = "number", tail: str = "") -> str:
    return f"WITH {REC} SELECT {select} FROM rec WHERE {where}{tail}"


GAME = "kind = 'game' AND "
#: name -> (search text, the condition in SQL)
SEARCHES = {
    "p04_text": ("red", "contains(lower(white || chr(1) || black || chr(1) || event || chr(1) || annotator), 'red')"),
    "p04_quoted": ('"essay 1" -france', "contains(lower(white || chr(1) || black || chr(1) || event || chr(1) || annotator), 'essay 1') AND NOT contains(lower(white || chr(1) || black || chr(1) || event || chr(1) || annotator), 'france')"),
    "p05_white": ("white:00012,00077", GAME + "(contains(lower(white), '00012') OR contains(lower(white), '00077'))"),
    "p05_black": ("black:0007", GAME + "contains(lower(black), '0007')"),
    "p05_player": ("player:0003", GAME + "(contains(lower(white), '0003') OR contains(lower(black), '0003'))"),
    "p06_event": ("tournament:essay", "contains(lower(event), 'essay')"),
    "p07_annotator": ("annotator:7,_1", "(contains(lower(annotator), '7') OR contains(lower(annotator), '_1'))"),
    "p08_result": ("result:draw,unknown", GAME + "result IN ('1/2-1/2', '*')"),
    "p09_eco_prefix": ("eco:c5,d", GAME + "(starts_with(eco, 'C5') OR starts_with(eco, 'D'))"),
    "p09_eco_range": ("eco:B2..C5", GAME + "eco >= 'B2' AND eco <= 'C5~'"),
    "p09_eco_above": ("eco:>C5", GAME + "eco > 'C5~'"),
    "p09_eco_below": ("eco:<C5", GAME + "eco <> '' AND eco < 'C5'"),
    "p10_date_prefix": ("date:1997-3", "kind <> 'text' AND starts_with(date_text, '1997.03')"),
    "p11_date_unknown": ("date:??", "kind <> 'text' AND contains(date_text, '??')"),
    "p12_date_range": ("date:1996-05..1997", "kind <> 'text' AND NOT contains(left(date_text, 7), '?') AND date_text >= '1996.05' AND date_text <= '1997~'"),
    "p12_date_above": ("date:>=1999-07", "kind <> 'text' AND NOT contains(left(date_text, 7), '?') AND date_text >= '1999.07'"),
    "p12_date_not_a_date": ("-date:>soon", "kind <> 'text'"),
    "p13_round": ("round:1", GAME + "contains(round_text, '1')"),
    "p14_moves": ("moves:20..40", "kind <> 'text' AND moves BETWEEN 20 AND 40"),
    "p14_moves_not_a_number": ("-moves:x", "kind <> 'text'"),
    "p15_elo": ("elo:>=2700", GAME + "(white_elo >= 2700 OR black_elo >= 2700)"),
    "p15_elo_two_terms": ("elo:>=2000 elo:<1500", GAME + "(white_elo >= 2000 OR black_elo >= 2000) AND (white_elo BETWEEN 1 AND 1499 OR black_elo BETWEEN 1 AND 1499)"),
    "p16_whiteelo": ("whiteelo:<1500", GAME + "white_elo > 0 AND white_elo < 1500"),
    "p16_blackelo": ("-blackelo:>1500", GAME + "NOT (black_elo > 0 AND black_elo > 1500)"),
    "p17_tc_normal": ("tc:normal", GAME + "tc = 0"),
    "p17_tc_blitz": ("tc:blitz", GAME + "(tc & 32) <> 0"),
    "p17_tc_rapid_corr": ("timecontrol:rapid,corr", GAME + "((tc & 64) <> 0 OR (tc & 128) <> 0)"),
    "p17_tc_other": ("-tc:bullet", "kind = 'game'"),
    "p18_open_ends": ("whiteelo:1800..* moves:..30", GAME + "white_elo > 0 AND white_elo >= 1800 AND moves <= 30"),
    "p19_kind_gating": ("-eco:A", GAME + "NOT starts_with(eco, 'A')"),
    "p20_negation": ("-eco:C5 -result:1-0", GAME + "NOT starts_with(eco, 'C5') AND result <> '1-0'"),
    "p_combo": ("event:a -result:1-0 eco:B..C date:1997-05..2000", GAME + "contains(lower(event), 'a') AND result <> '1-0' AND eco >= 'B' AND eco <= 'C~' AND NOT contains(left(date_text, 7), '?') AND date_text >= '1997.05' AND date_text <= '2000~'"),
}

_G = "CASE WHEN kind = 'game' THEN {} ELSE {} END"
ORDERS = {
    "number": ["number"],
    "white": ["lower(white)"],
    "black": ["lower(black)"],
    "whiteElo": ["white_elo"],
    "blackElo": ["black_elo"],
    "result": ["result"],
    "moves": ["moves"],
    "eco": ["eco"],
    "tournament": ["lower(event)"],
    "date": ["y", "m", "d"],
    "round": ["round", "subround"],
    "annotator": ["lower(annotator)"],
}


def _seq(spark, sf_dir):
    """(all games, those indexed, their plies by game, their visits by position)."""
    all_games, all_plies = adapters.sequences(spark, sf_dir)
    every = stored(spark, sf_dir, "games", ("events",), lambda: all_games, ("number",))
    games = explorer.eligible(every)
    plies = stored(spark, sf_dir, "plies", ("events",), lambda: all_plies.join(games.select("number"), "number", "left_semi"), ("number", "ply"))
    index = stored(spark, sf_dir, "visits", ("events",), lambda: explorer.visits(plies).join(explorer.carried(games, every), "number"), ("pos_key", "number"))
    return every, games, plies, index


def _pieces(spark, sf_dir):
    return adapters.boards(_seq(spark, sf_dir)[2])


def _q_window(spark, sf_dir):
    found, by = search.search(_db(spark, sf_dir), "result:1-0 sort:date", wanted=LISTED)
    return search.ranked(search.rows(search.window(found, by, 50, 100)), [F.col("date").desc(), F.col("number")]).select("number", "white", "black", "event", "date")


def _q_rows(spark, sf_dir):
    return search.rows(search.resolved(_db(spark, sf_dir), LISTED))


def _q_point(spark, sf_dir):
    return _db(spark, sf_dir).records.where("number = 42").select("number", "kind", "date_text")


def _q_range(spark, sf_dir):
    return _db(spark, sf_dir).records.where("number BETWEEN 1000 AND 1199").select("number", "kind", "moves")


def _q_total(spark, sf_dir):
    return search.search(_db(spark, sf_dir), "elo:>2000 -tc:blitz")[0].agg(F.count("*").alias("total"))


def _q_featured(spark, sf_dir):
    every, games, _, v = _seq(spark, sf_dir)
    return explorer.featured_games(v, games, every)


def _q_narrowed(spark, sf_dir):
    _, games, _, v = _seq(spark, sf_dir)
    some = games.where("white_elo >= 2000")
    return explorer.position_counts(v.join(some.select("number"), "number", "left_semi"))


def _q_narrowed_moves(spark, sf_dir):
    _, games, _, v = _seq(spark, sf_dir)
    return explorer.move_counts(v.join(games.where("white_elo >= 2000").select("number"), "number", "left_semi"))


def _q_moves(spark, sf_dir):
    return explorer.move_counts(_seq(spark, sf_dir)[3], code=F.col("move"))


def _q_lookup(spark, sf_dir):
    _, games, _, v = _seq(spark, sf_dir)
    return explorer.batch_lookup(v, games, spark.createDataFrame([(3,), (5,), (99,)], "pos_key bigint"))


def _members(spark, sf_dir, key):
    return explorer.games_of_position(_seq(spark, sf_dir)[3], key).select("number")


def _q_run(spark, sf_dir):
    plies = _seq(spark, sf_dir)[2]
    return fragment.first_run(plies, F.col("pos_key").bitwiseAND(F.lit(1)) == 1, length=3, first=4, last=60, move_number=F.col("ply"))


#: name -> (arguments of the fragment search, the condition in SQL)
FRAGMENTS = {
    "p22_look": ({"look": "Pg2,kb2"}, "(wp & {g2}) <> 0 AND (bk & {b2}) <> 0"),
    "p22_or": ({"any_of": "Nf3,Bc4,rh1"}, "((wn & {f3}) | (wb & {c4}) | (br & {h1})) <> 0"),
    "p22_exclude": ({"look": "Qd1", "exclude": "qd8,pe5", "no_black": "a1,b1"}, "(wq & {d1}) <> 0 AND (bq & {d8}) = 0 AND (bp & {e5}) = 0 AND ((bp | bn | bb | br | bq | bk) & ({a1} | {b1})) = 0"),
    "p23_files": ({"look": "Rb5", "mirror": "horizontal"}, "(wr & ({b5} | {g5})) <> 0"),
    "p23_ranks": ({"look": "Nb4", "no_white": "c1", "mirror": "vertical"}, "((wn & {b4}) <> 0 AND ((wp | wn | wb | wr | wq | wk) & {c1}) = 0) OR ((bn & {b5}) <> 0 AND ((bp | bn | bb | br | bq | bk) & {c8}) = 0)"),
    "p23_both": ({"look": "Ka2", "mirror": "both"}, "(wk & ({a2} | {h2})) <> 0 OR (bk & ({a7} | {h7})) <> 0"),
    "p24_material": ({"material_text": "P2,n..1,Q1..2,r2.."}, "bit_count(wp) = 2 AND bit_count(bn) <= 1 AND bit_count(wq) BETWEEN 1 AND 2 AND bit_count(br) >= 2"),
    "p26_masks": ({"look": "Pf3,nd5", "material_text": "B2"}, "(wp & {f3}) <> 0 AND (bn & {d5}) <> 0 AND bit_count(wb) = 2"),
}


def _fragment(name, spark, sf_dir):
    """With the masks of the games, which must not change what is found."""
    plies = _pieces(spark, sf_dir)
    return fragment.search(plies, **FRAGMENTS[name][0], game_masks=fragment.masks(plies))


def _fragment_sql(cond: str) -> str:
    named = {f + r: f"{1 << (8 * i + j)}::BIGINT" for i, r in enumerate("12345678") for j, f in enumerate("abcdefgh")}
    return f"WITH {SEQ}{PIECES} SELECT number, min(ply)::INT AS ply FROM b WHERE {cond.format(**named)} GROUP BY number"


def _q_masks(spark, sf_dir):
    return fragment.masks(_pieces(spark, sf_dir)).select("number", "wp", "bk", "least_wp", "most_wp", "least_bk", "most_bk")


def _q_buckets(spark, sf_dir):
    plies = _pieces(spark, sf_dir)
    targets = plies.where("pos_key IN (5, 77, 130)").select("pos_key", "structure").distinct()
    return explorer.games_by_structure(plies, explorer.structure_buckets(plies), targets)


def _q_structure(spark, sf_dir):
    return explorer.structure_buckets(_pieces(spark, sf_dir)).groupBy("number").agg(F.count("*").alias("structures"))


def _q_departed(spark, sf_dir):
    d = explorer.departures(_seq(spark, sf_dir)[2], F.expr("15 - pos_key"))
    return d.where(explorer.allows(F.split("departed", " ").cast("array<int>"), 0b0110, 4)).select("number")


def _q_acknowledged(spark, sf_dir):
    _, games, _, v = _seq(spark, sf_dir)
    members = explorer.games_of_position(v, 6)
    return explorer.acknowledged(members, games.where("white_elo >= 2000"))


def _q_heads(spark, sf_dir):
    records = _db(spark, sf_dir).records.withColumn("moves", F.col("moves") * 997).withColumn("white_id", F.col("white_id") * 5_000_011)
    return search.heads(records).select("number", "fits")


def _q_states(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return verify.state_counts(s.select(F.element_at(F.array(*map(F.lit, (*verify.STATES, "other"))), (F.col("s_suppkey") % 8 + 1).cast("int")).alias("state")))


def _q_latencies(spark, sf_dir):
    return verify.latencies(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_quantity")


def _q_union_first(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    entries = lambda m: o.where(k % m == 0).select(F.concat(F.lit("/games/"), (k % 4099).cast("string")).alias("path"), F.concat(F.lit(f"{m}-"), k.cast("string")).alias("name"), k.alias("pos"))
    return databases.first_of(entries(7), entries(5), entries(2))


def _q_signs(spark, sf_dir):
    """Titles with signs, letters that were signs, and layout marks put in by number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    put = F.element_at(F.array(*map(F.lit, ("\ue028d4", "Кл\ue008ев", "\ue02d\ue02dStartBracket\ue02dx\ue02dEndBracket\ue02d", "\ue005!", "×ернов", "Л×c3", "\ue020"))), (k % 7 + 1).cast("int"))
    return p.select(k.alias("id"), signs.signs_read(F.concat(put, F.lit(" "), "p_name")).alias("title"), signs.language_code((k % 300).cast("int")).alias("language"))


def _q_profile(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    flag, value = (k % 3).cast("int"), (k % 41 - 20).cast("int")
    h, m, s = scalars.time_spent(F.unhex(F.substring(F.md5(k.cast("string")), 1, 8)))
    sha = scalars.digests(F.col("p_name").cast("binary"))[1]
    return p.select(k.alias("id"), scalars.profile_value(flag, value).alias("profile"), scalars.mate_in_moves(flag, value).alias("mate"), h.alias("h"), m.alias("m"), s.alias("s"), sha.alias("sha"))


def _q_line(spark, sf_dir):
    plies = _seq(spark, sf_dir)[2].where("move IS NOT NULL AND ply < 8")
    return plies.groupBy("number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ply", "move"))), lambda x: x["move"]), " ").alias("line"))


def _q_text_links(spark, sf_dir):
    db = _db(spark, sf_dir)
    games = search.resolved(db, {"white", "black", "event"})
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    ln = c.select(
        k.alias("link_id"),
        F.when(k % 3 != 0, F.concat(F.lit("  "), "c_name")).otherwise("").alias("white"),
        F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 7).cast("string"), 9, "0"))).otherwise("").alias("black"),
        F.lit("").alias("event"),
    )
    return links.game_links(ln, games)


def _q_title_links(spark, sf_dir):
    db = _db(spark, sf_dir)
    ln = spark.range(0, 20).select(F.col("id").alias("link_id"), F.concat(F.lit(" Essay "), F.col("id").cast("string"), F.lit(" ")).alias("link_title"))
    return links.title_links(ln, db.records)


def _q_twins(spark, sf_dir):
    a = _db(spark, sf_dir).records.select("number", "result", "eco", "moves")
    n = F.col("number")
    b = a.where(n % 101 != 0).select(n, F.when(n % 50 == 0, "*").otherwise(F.col("result")).alias("result"), F.when(n % 75 == 0, None).otherwise(F.col("eco")).alias("eco"), F.least("moves", F.lit(40)).alias("moves"))
    return links.twin_differences(a, b.where(n % 2 == 1).unionByName(b.where(n % 2 == 0)), ["result", "eco", "moves"])


def _q_census(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return links.census(e.select("event_type", F.hour("ts").cast("int").alias("hour")), "event_type", "hour")


def _q_scalars(spark, sf_dir):
    r = _db(spark, sf_dir).records
    k = F.col("number").cast("long")  # products of an int would overflow from 3.5 million records on
    code = k * 37 % 65536
    y, m, d = scalars.packed_date(k * 613 % (1 << 21))
    return r.select(
        "number",
        scalars.eco_text(code).alias("eco_of_code"),
        scalars.date_text(y, m, d).alias("date_of_pack"),
        explorer.average_rating().alias("average"),
        F.nullif("y", F.lit(0)).alias("year"),
        scalars.round_text(k % 12, k % 5).alias("round_of"),
    )


def _q_tags(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tag = F.when(k % 7 == 0, "-").when(k % 7 == 1, "?").when(k % 7 == 2, F.concat(F.lit("40/"), (k % 9000).cast("string"))).otherwise(F.concat((k % 5000).cast("string"), F.lit("+"), (k % 40).cast("string")))
    return o.select(k.alias("id"), scalars.time_control_bits(tag).cast("int").alias("bits"), scalars.rating((k % 12000).cast("string")).alias("elo"), scalars.base64url(k.cast("string")).alias("b64"))


def _q_name_groups(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return suggest.name_groups(names)


def _q_name_ranks(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper("p_name").alias("name"))
    b = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"))
    return suggest.name_ranks(a, b, spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name")))


def _q_structures(spark, sf_dir):
    return explorer.structures(_seq(spark, sf_dir)[2], F.expr("pos_key & 3"))


def _q_departures(spark, sf_dir):
    return explorer.departures(_seq(spark, sf_dir)[2], F.expr("15 - pos_key"))


def _q_merged(spark, sf_dir):
    _, games, plies, _ = _seq(spark, sf_dir)
    odd, even = games.where("number % 2 = 1"), games.where("number % 2 = 0")
    v = explorer.visits(plies)
    return explorer.merge_counts(explorer.position_counts(v, odd), explorer.position_counts(v, even))


def _suggested(field, prefix, spark, sf_dir):
    return suggest.suggest(_db(spark, sf_dir), field, prefix)


def _suggest_sql(source: str, prefix: str) -> str:
    return f"""WITH {REC}, n AS ({source}), c AS (SELECT name, count(DISTINCT number) AS games FROM n WHERE name <> '' GROUP BY name),
t AS (SELECT name, games, row_number() OVER (ORDER BY games DESC, lower(name), name) AS rank FROM c WHERE starts_with(lower(name), '{prefix}'))
SELECT * FROM t WHERE rank <= 20"""


def _e(sql: str) -> str:
    return f"WITH {SEQ} {sql}"


_COUNTS = "count(*) AS games, count_if(outcome = 'white')::BIGINT AS white, count_if(outcome = 'draw')::BIGINT AS draws, count_if(outcome = 'black')::BIGINT AS black"
_DAY = "try_cast(y || '-' || lpad(greatest(m, 1)::VARCHAR, 2, '0') || '-' || lpad(greatest(d, 1)::VARCHAR, 2, '0') AS DATE)"
_RUN = "WITH {seq}, g AS (SELECT number, ply, ply - row_number() OVER (PARTITION BY number ORDER BY ply) AS i FROM lines WHERE {cond}), r AS (SELECT number, i, min(ply) AS ply, count(*) AS n FROM g GROUP BY number, i) SELECT number, min(ply)::INT AS ply FROM r WHERE n >= {n} GROUP BY number"


def _run_sql(cond: str, n: int = 1) -> str:
    return _RUN.format(seq=SEQ, cond=cond, n=n)


MORE = {
    "s03_point": (_q_point, _rec("number = 42", "number, kind, date_text")),
    "s04_range": (_q_range, _rec("number BETWEEN 1000 AND 1199", "number, kind, moves")),
    "o11_window": (_q_window, f"WITH {REC}, w AS (SELECT * FROM rec WHERE kind = 'game' AND result = '1-0' ORDER BY y DESC, m DESC, d DESC, number LIMIT 100 OFFSET 50) SELECT number, white, black, event, date_text AS date FROM w"),
    "r01_rows": (_q_rows, _rec("true", "number, kind, deleted, chess960, white, black, event, annotator, result, eco, CASE WHEN kind = 'text' THEN '????.??.??' ELSE date_text END AS date, round_text AS round, white_elo, black_elo, moves")),
    "a01_total": (_q_total, _rec(GAME + "(white_elo > 2000 OR black_elo > 2000) AND NOT ((tc & 32) <> 0)", "count(*) AS total")),
    "a08_suggest_player": (partial(_suggested, "player", "customer#00000001"), _suggest_sql("SELECT number, white AS name FROM rec WHERE kind = 'game' UNION SELECT number, black FROM rec WHERE kind = 'game'", "customer#00000001")),
    "a08_suggest_event": (partial(_suggested, "event", "b"), _suggest_sql("SELECT number, event AS name FROM rec WHERE kind = 'game'", "b")),
    "a08_suggest_annotator": (partial(_suggested, "annotator", ""), _suggest_sql("SELECT number, annotator AS name FROM rec WHERE kind = 'game'", "")),
    "a09_name_groups": (_q_name_groups, 'SELECT p_name AS name, min(p_partkey) AS "group", count(*) AS ids FROM part WHERE p_name <> \'\' GROUP BY p_name'),
    "a10_name_ranks": (_q_name_ranks, "WITH n AS (SELECT upper(p_name) AS name FROM part UNION SELECT p_name FROM part UNION SELECT n_name FROM nation) SELECT name, dense_rank() OVER (ORDER BY lower(name)) AS rank FROM n WHERE name <> ''"),
    "w01_visits": (lambda s, d: _seq(s, d)[3].select("number", "pos_key", "ply", "move"), _e("SELECT number, pos_key, ply, nullif(move, '-') AS move FROM visits")),
    "a02_position_counts": (lambda s, d: explorer.position_counts(_seq(s, d)[3], _seq(s, d)[1]), _e(f"SELECT pos_key, {_COUNTS} FROM visits JOIN games USING (number) GROUP BY pos_key")),
    "a03_moves": (_q_moves, _e(f", c AS (SELECT pos_key, move, {_COUNTS}, min(number) AS first_number FROM visits JOIN games USING (number) WHERE move <> '-' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY pos_key ORDER BY games DESC, move) AS rank FROM c")),
    "a04_narrowed_moves": (_q_narrowed_moves, _e(f", c AS (SELECT pos_key, move, {_COUNTS}, min(number) AS first_number FROM visits JOIN games USING (number) WHERE move <> '-' AND white_elo >= 2000 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY pos_key ORDER BY games DESC, first_number) AS rank FROM c")),
    "a05_top12": (lambda s, d: explorer.top_games(_seq(s, d)[3], _seq(s, d)[1]), _e(", r AS (SELECT pos_key, number, least(CASE WHEN white_elo > 0 AND black_elo > 0 THEN (white_elo + black_elo) // 2 ELSE white_elo + black_elo END, 4095)::INT AS rating FROM visits JOIN games USING (number)), t AS (SELECT *, row_number() OVER (PARTITION BY pos_key ORDER BY rating DESC, number DESC) AS rank FROM r) SELECT pos_key, rank, number, rating FROM t WHERE rank <= 12")),
    "a06_featured12": (_q_featured, _e(f", a AS (SELECT max({_DAY}) AS anchor FROM every WHERE kind = 'game' AND NOT deleted), r AS (SELECT pos_key, number, {_DAY} AS day, (CASE WHEN white_elo <= 0 THEN 1500 ELSE white_elo END + CASE WHEN black_elo <= 0 THEN 1500 ELSE black_elo END)::INT AS total, anchor FROM visits JOIN games USING (number), a), s AS (SELECT *, CASE WHEN day >= anchor - INTERVAL 1 YEAR AND total >= 5400 THEN 3 WHEN day >= anchor - INTERVAL 3 YEAR AND total >= 5200 THEN 2 WHEN day >= anchor - INTERVAL 5 YEAR AND total >= 4800 THEN 1 ELSE 0 END::INT AS tier FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY pos_key ORDER BY tier DESC, total DESC, number DESC) AS rank FROM s) SELECT pos_key, rank, number, tier, total FROM t WHERE rank <= 12")),
    "a15_anchor": (lambda s, d: explorer.anchor(_seq(s, d)[0]), _e(f"SELECT max({_DAY}) AS anchor FROM every WHERE kind = 'game' AND NOT deleted")),
    "u04_merged_counts": (_q_merged, _e(f"SELECT pos_key, {_COUNTS} FROM visits JOIN games USING (number) GROUP BY pos_key")),
    "w05_depth": (lambda s, d: explorer.visits(_seq(s, d)[2], 20), _e(", v AS (SELECT number, pos_key, min(ply) AS ply, arg_min(coalesce(move, '-'), ply) AS move FROM lines WHERE ply <= 20 GROUP BY ALL) SELECT number, pos_key, ply, nullif(move, '-') AS move FROM v")),
    "j04_narrowed": (_q_narrowed, _e(f"SELECT pos_key, {_COUNTS} FROM visits JOIN games USING (number) WHERE white_elo >= 2000 GROUP BY pos_key")),
    "j06_batch_lookup": (_q_lookup, _e(f", t AS (SELECT unnest([3, 5, 99])::BIGINT AS pos_key), c AS (SELECT pos_key, {_COUNTS} FROM visits JOIN games USING (number) GROUP BY pos_key) SELECT t.pos_key, coalesce(games, 0) AS games, coalesce(white, 0) AS white, coalesce(draws, 0) AS draws, coalesce(black, 0) AS black FROM t LEFT JOIN c USING (pos_key)")),
    "p21_games_of_position": (lambda s, d: explorer.games_of_position(_seq(s, d)[3], 6), _e("SELECT number, min(ply) AS ply FROM lines WHERE pos_key = 6 GROUP BY number")),
    "u01_union": (lambda s, d: _members(s, d, 3).union(_members(s, d, 5)).distinct(), _e("SELECT DISTINCT number FROM lines WHERE pos_key IN (3, 5)")),
    "u02_intersect": (lambda s, d: _members(s, d, 3).intersect(_members(s, d, 5)), _e("SELECT number FROM lines WHERE pos_key = 3 INTERSECT SELECT number FROM lines WHERE pos_key = 5")),
    "u03_complement": (lambda s, d: _members(s, d, 3).join(_members(s, d, 5), "number", "left_anti"), _e("SELECT number FROM lines WHERE pos_key = 3 EXCEPT SELECT number FROM lines WHERE pos_key = 5")),
    "p25_run": (_q_run, _run_sql("(pos_key & 1) = 1 AND ply BETWEEN 4 AND 60", 3)),
    "a13_mask_rows": (_q_masks, f"WITH {SEQ}{PIECES} SELECT number, bit_or(wp) AS wp, bit_or(bk) AS bk, min(bit_count(wp))::TINYINT AS least_wp, max(bit_count(wp))::TINYINT AS most_wp, min(bit_count(bk))::TINYINT AS least_bk, max(bit_count(bk))::TINYINT AS most_bk FROM b GROUP BY number"),
    "j07_structure_join": (_q_buckets, f"WITH {SEQ}{PIECES} SELECT pos_key, number, min(ply) AS ply FROM b WHERE pos_key IN (5, 77, 130) GROUP BY pos_key, number"),
    "f22_structures": (_q_structure, f"WITH {SEQ}{PIECES}, s AS (SELECT DISTINCT number, wp, bp, {', '.join(f'bit_count({side + kind}) AS n_{side + kind}' for kind in 'nbrq' for side in 'wb')} FROM b) SELECT number, count(*) AS structures FROM s GROUP BY number"),
    "p27_departure_order": (_q_departed, _e(", s AS (SELECT number, ply, lag(15 - pos_key) OVER (PARTITION BY number ORDER BY ply) AS was, 15 - pos_key AS now FROM lines), f AS (SELECT number, bit, min(ply) AS ply FROM s, unnest([0, 1, 2, 3]) AS t(bit) WHERE ((was >> bit) & 1) = 1 AND ((now >> bit) & 1) = 0 GROUP BY number, bit), r AS (SELECT number, bit, row_number() OVER (PARTITION BY number ORDER BY ply, bit) AS i FROM f) SELECT number FROM r WHERE i <= 2 GROUP BY number HAVING count(*) = 2 AND bool_and(bit IN (0, 3))")),
    "r06_acknowledged": (_q_acknowledged, _e("SELECT count(DISTINCT number) AS games, count(DISTINCT CASE WHEN white_elo >= 2000 THEN number END) AS total FROM lines JOIN games USING (number) WHERE pos_key = 6")),
    "r08_heads": (_q_heads, f"WITH {REC} SELECT number, (kind = 'text' OR moves * 997 <= 32767) AND (kind <> 'game' OR o_custkey::BIGINT * 2 * 5000011 <= 2147483647) AS fits FROM rec JOIN orders ON o_orderkey + 1 = number"),
    "a16_states": (_q_states, "SELECT " + ", ".join(f'count_if(s_suppkey % 8 = {i})::BIGINT AS "{s}"' for i, s in enumerate(verify.STATES)) + " FROM supplier"),
    "a19_latencies": (_q_latencies, "WITH l AS (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS v, count(l_quantity) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_returnflag) SELECT l_returnflag, n, v[n // 2 + 1] AS median, v[n * 95 // 100 + 1] AS p95, v[n] AS max FROM l"),
    "u05_union_first": (_q_union_first, "WITH e AS (SELECT '/games/' || (o_orderkey % 4099) AS path, m || '-' || o_orderkey AS name, i::INT AS list, o_orderkey AS pos FROM orders, (VALUES (0, 7), (1, 5), (2, 2)) AS t(i, m) WHERE o_orderkey % m = 0) SELECT path, name, list, pos FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY list, pos, name) = 1"),
    "s16_signs": (_q_signs, "SELECT p_partkey AS id, (['♘d4', 'Клюев', '(x)', '!', 'Чернов', 'Л×c3', chr(57376)])[p_partkey % 7 + 1] || ' ' || p_name AS title, CASE p_partkey % 300 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' WHEN 4 THEN 'it' WHEN 5 THEN 'nl' WHEN 6 THEN 'pt' WHEN 7 THEN 'any' WHEN 12 THEN 'pl' WHEN 18 THEN 'el' ELSE CASE WHEN p_partkey % 300 >= 256 THEN 'cb-' || (p_partkey % 300 - 256) ELSE 'cb-l' || (p_partkey % 300) END END AS language FROM part"),
    "f25_records": (_q_profile, "WITH x AS (SELECT p_partkey AS k, p_name, (p_partkey % 3)::INT AS flag, (p_partkey % 41 - 20)::INT AS v, md5(p_partkey::VARCHAR) AS d FROM part), t AS (SELECT *, ('0x' || substr(d, 3, 2))::INT AS s, ('0x' || substr(d, 5, 2))::INT AS m, ('0x' || substr(d, 7, 2))::INT AS h FROM x) SELECT k AS id, CASE WHEN flag = 0 THEN v WHEN flag = 1 AND v > 0 THEN 30000 - v WHEN flag = 1 AND v < 0 THEN -30000 - v ELSE 32767 END::INT AS profile, CASE WHEN flag = 1 AND v <> 0 THEN sign(v) * ((abs(v) + 1) // 2) END::INT AS mate, CASE WHEN s < 60 AND m < 60 THEN h END AS h, CASE WHEN s < 60 AND m < 60 THEN m END AS m, CASE WHEN s < 60 AND m < 60 THEN s END AS s, sha256(p_name) AS sha FROM t"),
    "r03_line": (_q_line, _e("SELECT number, string_agg(move, ' ' ORDER BY ply) AS line FROM lines WHERE move IS NOT NULL AND ply < 8 GROUP BY number")),
    "a14_structures": (_q_structures, _e(", s AS (SELECT number, pos_key & 3 AS structure, ply, lag(pos_key & 3) OVER (PARTITION BY number ORDER BY ply) AS b FROM lines WHERE ply > 20) SELECT number, structure, ply FROM s WHERE b IS NULL OR b <> structure")),
    "w08_departures": (_q_departures, _e(", s AS (SELECT number, ply, lag(15 - pos_key) OVER (PARTITION BY number ORDER BY ply) AS was, 15 - pos_key AS now FROM lines), g AS (SELECT number, ply, bit FROM s, unnest([0, 1, 2, 3]) AS t(bit) WHERE ((was >> bit) & 1) = 1 AND ((now >> bit) & 1) = 0), f AS (SELECT number, bit, min(ply) AS ply FROM g GROUP BY number, bit) SELECT number, string_agg(bit::VARCHAR, ' ' ORDER BY ply, bit) AS departed FROM f GROUP BY number")),
    "j08_text_links": (_q_text_links, f"WITH {REC}, l AS (SELECT c_custkey AS link_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END AS w, CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || lpad((c_custkey % 7)::VARCHAR, 9, '0') ELSE '' END AS b FROM customer) SELECT link_id, min(number) AS number FROM l JOIN rec ON kind = 'game' AND number <= 100000 AND (w = '' OR w = white) AND (b = '' OR b = black) GROUP BY link_id"),
    "j09_title_links": (_q_title_links, f"WITH {REC} SELECT i AS link_id, min(number) AS number FROM range(20) AS t(i) JOIN rec ON kind = 'text' AND event = 'Essay ' || i GROUP BY i"),
    "j10_twin_diff": (_q_twins, f"WITH {REC}, a AS (SELECT number, result, nullif(eco, '') AS eco, moves FROM rec), b AS (SELECT number, CASE WHEN number % 50 = 0 THEN '*' ELSE result END AS result, CASE WHEN number % 75 = 0 THEN NULL ELSE eco END AS eco, least(moves, 40) AS moves FROM a WHERE number % 101 <> 0), j AS (SELECT a.number, CASE WHEN b.number IS NULL THEN 'only left' ELSE concat_ws(',', CASE WHEN a.result IS DISTINCT FROM b.result THEN 'result' END, CASE WHEN a.eco IS DISTINCT FROM b.eco THEN 'eco' END, CASE WHEN a.moves IS DISTINCT FROM b.moves THEN 'moves' END) END AS difference FROM a LEFT JOIN b USING (number)) SELECT * FROM j WHERE difference <> ''"),
    "a17_verify": (lambda s, d: links.verify_counts(_db(s, d).records), _rec("true", "count(*) AS records, count_if(kind = 'game')::BIGINT AS games, count_if(kind = 'text')::BIGINT AS texts, count_if(kind = 'analysis')::BIGINT AS analyses, count_if(deleted)::BIGINT AS deleted, count_if(chess960)::BIGINT AS chess960, count_if(eco = '')::BIGINT AS no_eco, count_if(contains(date_text, '?'))::BIGINT AS partial_dates, count_if(kind = 'game' AND white_elo <= 0 AND black_elo <= 0)::BIGINT AS unrated, sum(moves)::BIGINT AS full_moves")),
    "b01_info": (lambda s, d: verify.info(_db(s, d)), "SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS players, (SELECT count(*) FROM part) AS tournaments, (SELECT count(*) FROM nation) AS annotators"),
    "a18_census": (_q_census, "SELECT event_type, hour(ts)::INT AS hour, count(*) AS items FROM events GROUP BY ALL"),
    "f_scalars": (_q_scalars, f"WITH {REC}, x AS (SELECT *, number * 37 % 65536 AS code, number::BIGINT * 613 % 2097152 AS p FROM rec) SELECT number, CASE WHEN code BETWEEN 128 AND 64127 THEN chr((65 + (code // 128 - 1) // 100)::INT) || lpad(((code // 128 - 1) % 100)::VARCHAR, 2, '0') END AS eco_of_code, (CASE WHEN p >> 9 > 0 THEN lpad((p >> 9)::VARCHAR, 4, '0') ELSE '????' END) || '.' || (CASE WHEN ((p >> 5) & 15) > 0 THEN lpad(((p >> 5) & 15)::VARCHAR, 2, '0') ELSE '??' END) || '.' || (CASE WHEN (p & 31) > 0 THEN lpad((p & 31)::VARCHAR, 2, '0') ELSE '??' END) AS date_of_pack, least(CASE WHEN white_elo > 0 AND black_elo > 0 THEN (white_elo + black_elo) // 2 ELSE white_elo + black_elo END, 4095)::INT AS average, nullif(y, 0) AS year, CASE WHEN number % 12 <= 0 THEN '' WHEN number % 5 > 0 THEN (number % 12) || '(' || (number % 5) || ')' ELSE (number % 12)::VARCHAR END AS round_of FROM x"),
    "f_tags": (_q_tags, "WITH x AS (SELECT o_orderkey AS k FROM orders), y AS (SELECT k, CASE WHEN k % 7 IN (0, 1) THEN 0 WHEN k % 7 = 2 THEN k % 9000 ELSE k % 5000 + 60 * (k % 40) END AS total FROM x) SELECT k AS id, CASE WHEN k % 7 = 0 THEN 128 WHEN total > 0 AND total <= 600 THEN 32 WHEN total > 0 AND total < 3600 THEN 64 ELSE 0 END::INT AS bits, CASE WHEN k % 12000 <= 9999 THEN k % 12000 ELSE 0 END::INT AS elo, rtrim(translate(base64(k::VARCHAR::BLOB), '+/', '-_'), '=') AS b64 FROM y"),
}


#: Node counts of known positions: (FEN, depth).
PERFT = (
    (chess.START, 3),
    ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 2),
    ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 3),
)


def _q_perft(spark, sf_dir):
    t = spark.createDataFrame(PERFT, "fen string, depth int")
    count = F.pandas_udf(lambda f, d: f.combine(d, lambda x, n: chess.perft(chess.Board.from_fen(x), n)), "bigint")
    return t.select("fen", "depth", count("fen", "depth").alias("nodes"))


def _generated(spark):
    lines = synthetic.games(spark, 240, 24)
    games = lines.select("number", F.element_at(F.array(*map(F.lit, ("white", "draw", "black", "other"))), F.col("number") % 4 + 1).alias("outcome"))
    return lines, games


def _q_explorer_pgn(spark, sf_dir):
    lines, games = _generated(spark)
    return explorer.position_counts(explorer.visits(pgn.plies(lines)), games)


def _q_fragment_pgn(spark, sf_dir):
    plies = pgn.plies(_generated(spark)[0])
    return fragment.search(plies, look="Pe4", exclude="pe5", material_text="P7..8", mirror="horizontal", length=2, game_masks=fragment.masks(plies))


def _q_roundtrip(spark, sf_dir):
    """Games rendered as PGN text and read again by the movetext parser: lines that differ."""
    lines, _ = _generated(spark)
    sans = pgn.lines_of_ucis(lines)
    text = sans.select("number", pgn.render(F.create_map(F.lit("White"), F.lit("A")), F.col("sans"), F.lit("*")).alias("pgn"))
    again = pgn.lines(text.select("number", F.lit(None).cast("map<string,string>").alias("tags"), F.element_at(F.split("pgn", "\n\n", 2), 2).alias("movetext")))
    return sans.join(again.select("number", F.col("ucis").alias("read")), "number").select("number", F.size("ucis").alias("plies"), (F.col("ucis") == F.col("read")).alias("same"))


def _q_verify(spark, sf_dir):
    return verify.line_counts(pgn.lines_of_ucis(_generated(spark)[0]).withColumn("complete", F.lit(True)))


CHESS = {"c_verify": _q_verify, "c_perft": _q_perft, "c_explorer_pgn": _q_explorer_pgn, "c_fragment_pgn": _q_fragment_pgn, "c_pgn_roundtrip": _q_roundtrip}


def queries() -> dict:
    out = {k: partial(_search, text) for k, (text, _) in SEARCHES.items()}
    for key in ORDERS:
        for way in ("asc", "desc"):
            out[f"o03_sort_{key.lower()}_{way}"] = partial(_sorted, f"-chess960 sort:{key}-{way}")
    return out | {k: f for k, (f, _) in MORE.items()} | {k: partial(_fragment, k) for k in FRAGMENTS} | CHESS


def oracle_sql() -> dict[str, str]:
    out = {k: _rec(cond) for k, (_, cond) in SEARCHES.items()}
    for key, cols in ORDERS.items():
        for way in ("asc", "desc"):
            by = ", ".join(f"{c} {way}" for c in cols)
            out[f"o03_sort_{key.lower()}_{way}"] = _rec("true", f"number, row_number() OVER (ORDER BY {by}, number) AS rank")
    return out | {k: sql for k, (_, sql) in MORE.items()} | {k: _fragment_sql(cond) for k, (_, cond) in FRAGMENTS.items()}
