"""Explorer, fragments and PGN against plain Python on generated games."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ranksmith.functions import chess, scalars
from ranksmith.operators import explorer, fragment, links
from ranksmith.sources import codepages, pgn, snapshots, synthetic
from ranksmith.streaming import counts

N = 40


@pytest.fixture(scope="module")
def lines():
    return {i: synthetic.game(i, 14) for i in range(1, N + 1)}


@pytest.fixture(scope="module")
def plies(spark):
    return pgn.plies(synthetic.games(spark, N, 14)).cache()


@pytest.fixture(scope="module")
def boards(lines):
    out = {}
    for i, ucis in lines.items():
        b = chess.Board.from_fen(chess.START)
        out[i] = [b]
        for u in ucis:
            b = b.played(b.from_uci(u))
            out[i].append(b)
    return out


@pytest.fixture(scope="module")
def games(spark):
    r = random.Random(29)
    rows = []
    for i in range(1, N + 1):
        elos = [r.choice((0, r.randint(1800, 2850), r.randint(2550, 2850))) for _ in "wb"]
        rows.append((i, "game", r.random() < 0.1, False, r.choice(("white", "draw", "black", "other")), *elos, r.randint(1985, 2024), r.randrange(14), r.randrange(32)))
    return spark.createDataFrame(rows, "number int, kind string, deleted boolean, chess960 boolean, outcome string, white_elo int, black_elo int, y int, m int, d int").cache()


def test_explorer(plies, games, boards, lines):
    some = {r["number"]: r for r in games.collect() if not r["deleted"]}
    want, moves = {}, {}
    for n in some:
        seen = set()
        for i, b in enumerate(boards[n]):
            k = b.key()
            if k in seen:
                continue
            seen.add(k)
            w = want.setdefault(k, [0, 0, 0, 0])
            w[0] += 1
            o = some[n]["outcome"]
            if o != "other":
                w[("white", "draw", "black").index(o) + 1] += 1
            if i < len(lines[n]):
                moves.setdefault(k, {}).setdefault(lines[n][i], []).append(n)
    ok = explorer.eligible(games)
    v = explorer.visits(plies.join(ok.select("number"), "number", "left_semi"))
    assert {r["pos_key"]: [r["games"], r["white"], r["draws"], r["black"]] for r in explorer.position_counts(v, ok).collect()} == want
    got = {}
    for r in explorer.move_counts(v, ok).collect():
        got.setdefault(r["pos_key"], []).append((r["rank"], r["move"], r["games"]))
    for k, m in moves.items():
        by = sorted(m, key=lambda x: (-len(m[x]), min(m[x])))
        assert sorted(got[k]) == [(i + 1, x, len(m[x])) for i, x in enumerate(by)]
    start = chess.Board.from_fen(chess.START).key()
    avg = lambda r: (r["white_elo"] + r["black_elo"]) // 2 if r["white_elo"] and r["black_elo"] else r["white_elo"] + r["black_elo"]
    top = [r["number"] for r in sorted(explorer.top_games(v, ok).where(F.col("pos_key") == start).collect(), key=lambda r: r["rank"])]
    assert top == sorted(some, key=lambda n: (-avg(some[n]), -n))[:12]


def test_featured(plies, games):
    rows = {r["number"]: r for r in games.collect()}

    def day(r):
        try:
            return datetime.date(r["y"], max(r["m"], 1), max(r["d"], 1))
        except ValueError:
            return None

    newest = max(d for r in rows.values() if not r["deleted"] and (d := day(r)))
    back = lambda n: newest.replace(year=newest.year - n)
    total = lambda r: (r["white_elo"] or 1500) + (r["black_elo"] or 1500)

    def tier(r):
        d = day(r)
        return 0 if d is None else 3 if d >= back(1) and total(r) >= 5400 else 2 if d >= back(3) and total(r) >= 5200 else 1 if d >= back(5) and total(r) >= 4800 else 0

    ok = [r for r in rows.values() if not r["deleted"]]
    want = [r["number"] for r in sorted(ok, key=lambda r: (-tier(r), -total(r), -r["number"]))][:12]
    start = chess.Board.from_fen(chess.START).key()
    v = explorer.visits(plies)
    found = explorer.featured_games(v.join(explorer.eligible(games).select("number"), "number", "left_semi"), explorer.eligible(games), games)
    assert [r["number"] for r in sorted(found.where(F.col("pos_key") == start).collect(), key=lambda r: r["rank"])] == want


def test_index_visits_equal_visits_of_plies(spark, plies, games):
    lines = plies.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("ply", "pos_key", "move"))).alias("p"))
    lines = lines.select("number", F.col("p.pos_key").alias("keys"), F.expr("filter(transform(p, x -> x.move), m -> m IS NOT NULL)").alias("moves"))
    ok = explorer.eligible(games)
    index = explorer.index_visits(lines, ok, games).cache()
    v = explorer.visits(plies.join(ok.select("number"), "number", "left_semi"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(index.select("number", "pos_key", "ply", "move")) == rows(v.select("number", "pos_key", "ply", "move"))
    assert rows(explorer.position_counts(index)) == rows(explorer.position_counts(v, ok))
    assert rows(explorer.move_counts(index)) == rows(explorer.move_counts(v, ok))
    assert rows(explorer.top_games(index)) == rows(explorer.top_games(v, ok))
    assert rows(explorer.featured_games(index)) == rows(explorer.featured_games(v, ok, games))


CASES = [
    {"look": "Pe4"},
    {"look": "Pe4", "exclude": "pe5", "mirror": "horizontal"},
    {"any_of": "Nf3,Nc3,nf6", "no_black": "d5,e5", "mirror": "both"},
    {"look": "pd5", "mirror": "vertical", "length": 3},
    {"material_text": "P7,p8..", "first": 3, "last": 7},
    {"look": "Kg1,Rf1", "length": 2},
]


@pytest.mark.parametrize("case", CASES)
def test_fragments(plies, boards, case):
    p = fragment.Pattern(fragment.pieces(case.get("look", ""), "look"), fragment.pieces(case.get("any_of", ""), "or"), fragment.pieces(case.get("exclude", ""), "exclude"), 0, fragment.squares(case.get("no_black", ""), "noblack"))
    ranges = fragment.material(case.get("material_text", ""))
    patterns = fragment.variants(p, case.get("mirror", "none"))

    def holds(b):
        bits = dict(zip(fragment.BOARDS, (x & (1 << 64) - 1 for x in b.bitboards())))
        side = lambda c: sum(v for k, v in bits.items() if k[0] == c)
        if any(not lo <= bits[k].bit_count() <= hi for k, (lo, hi) in ranges.items()):
            return False
        return any(
            all(bits[k] & s == s for k, s in q.look.items()) and all(not bits[k] & s for k, s in q.exclude.items()) and not side("w") & q.no_white and not side("b") & q.no_black and (not q.any_of or any(bits[k] & s for k, s in q.any_of.items()))
            for q in patterns
        )

    want = {}
    for n, line in boards.items():
        run = 0
        for i, b in enumerate(line):
            inside = case.get("first", 1) <= b.move <= case.get("last", 1 << 30)
            run = run + 1 if inside and holds(b) else 0
            if run == case.get("length", 1):
                want[n] = i - run + 1
                break
    assert {r["number"]: r["ply"] for r in fragment.search(plies, **case).collect()} == want
    assert {r["number"]: r["ply"] for r in fragment.search(plies, **case, game_masks=fragment.masks(plies)).collect()} == want


@pytest.mark.parametrize(
    "fen,depth,nodes",
    [
        (chess.START, 3, 8902),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 3, 97862),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 4, 43238),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", 3, 9467),
        ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 3, 62379),
        ("r4rk1/1pp1qppp/p1np1n2/2b1p1B1/2B1P1b1/P1NP1N2/1PP1QPPP/R4RK1 w - - 0 10", 2, 2079),
    ],
)
def test_perft(fen, depth, nodes):
    b = chess.Board.from_fen(fen)
    assert b.fen() == fen and chess.perft(b, depth) == nodes


def test_chess960():
    assert chess.chess960_rank(518) == "RNBQKBNR"
    ranks = {chess.chess960_rank(n) for n in range(960)}
    assert len(ranks) == 960
    assert all(r.index("B") % 2 != r.rindex("B") % 2 and r.index("R") < r.index("K") < r.rindex("R") for r in ranks)


def test_keys_and_san(boards):
    b = chess.Board.from_fen(chess.START)
    play = lambda *u: __import__("functools").reduce(lambda x, m: x.played(x.from_uci(m)), u, b)
    assert play("g1f3", "g8f6", "b1c3").key() == play("b1c3", "g8f6", "g1f3").key()
    assert play("e2e4").key() == chess.Board.from_fen("rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1").key()
    pinned = chess.Board.from_fen("4k3/8/8/8/1b6/2N5/8/4K1N1 w - - 0 1")
    assert pinned.san(pinned.from_uci("g1e2")) == "Ne2"
    for line in boards.values():
        for x, y in zip(line, line[1:]):
            m = next(m for m in x.legal() if x.played(m).fen() == y.fen())
            assert x.from_san(x.san(m)) == m
    assert b.from_san("Nd2") is None and b.from_san("e8Q") is None
    c = chess.Board.from_fen("r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1")
    assert c.uci(c.from_san("0-0")) == "e1g1" and c.uci(c.from_san("O-O-O+")) == "e1c1"


@pytest.mark.parametrize("fen", ["", "8/8/8/8/8/8/8/8 w - - 0 1", "k7/8/8/8/8/8/8/K6P w - - 0 1", "kK6/8/8/8/8/8/8/8 w - - 0 1", "9/8/8/8/8/8/8/8 w - - 0 1"])
def test_bad_positions(fen):
    with pytest.raises(chess.BadPosition):
        chess.Board.from_fen(fen)


PGN = (
    '﻿[Event "First \\"q\\" event"]\n[White "Arden, P."]\n[Black "?"]\n[Date "1997.??.??"]\n[Round "3.2"]\n[WhiteElo "2510"]\n[ECO "b20"]\n[TimeControl "180+2"]\n[Result "1-0"]\n\n1. e4 {an open comment (} c5 2. Nf3 (2. c3 d5) d6 3. Bb5+ 1-0\n\n'
    '[Event "Second"]\r\n[Result "1/2"]\r\n\r\n1.d4 d5 2.c4 {never closed\r\n\n'
    '[Event "Third"]\n[FEN "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1"]\n\n1. 0-0 O-O-O 2. Kh9 0-0\n[Site "no event"]\n[Site "again"]\n\n*\n'
)


def test_pgn(spark, tmp_path):
    (tmp_path / "a.pgn").write_text(PGN, encoding="utf-8")
    games = pgn.read_text(spark, str(tmp_path)).cache()
    r = {x["number"]: x for x in pgn.records(games).collect()}
    assert [r[i]["event"] for i in sorted(r)] == ['First "q" event', "Second", "Third", "", ""]
    one = r[1]
    assert (one["white"], one["black"], one["date_text"], one["round_text"], one["white_elo"], one["eco"], one["tc"], one["result"]) == ("Arden, P.", "", "1997.??.??", "3(2)", 2510, "B20", 0x20, "1-0")
    assert r[2]["result"] == "1/2-1/2"
    line = {x["number"]: x for x in pgn.lines(games).collect()}
    assert line[1]["sans"] == ["e4", "c5", "Nf3", "d6", "Bb5+"] and line[1]["complete"]
    assert line[2]["sans"] == ["d4", "d5", "c4"]
    assert line[3]["ucis"] == ["e1g1", "e8c8"] and not line[3]["complete"]


def test_pgn_round_trip(spark, tmp_path, lines):
    src = pgn.lines_of_ucis(synthetic.games(spark, N, 14))
    tags = F.create_map(F.lit("Event"), F.concat(F.lit("E"), F.col("number").cast("string")), F.lit("Note"), F.lit('a "b" \\'))
    pgn.write(src.select("number", pgn.render(tags, F.col("sans"), F.lit("0-1")).alias("pgn")), str(tmp_path / "out"), 3)
    games = pgn.read_text(spark, str(tmp_path / "out"))
    back = {r["number"]: r for r in pgn.lines(games).collect()}
    assert {n: r["ucis"] for n, r in back.items()} == lines
    assert {r["number"]: r["tags"]["Event"] for r in games.collect()} == {n: f"E{n}" for n in lines}
    assert {r["tags"]["Note"] for r in games.collect()} == {'a "b" \\'}


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "base")
    schema = "number int, tags map<string,string>, movetext string"
    g = snapshots.create(spark.createDataFrame([(1, {"White": "A"}, "1. e4 *"), (2, {"White": "B"}, "*")], schema), at)
    g2 = snapshots.append(spark, at, g, spark.createDataFrame([(0, {"White": "C"}, "1. d4 *")], "pos int, tags map<string,string>, movetext string"))
    g3 = snapshots.replace(spark, at, g2, 2, {"White": "B2"}, "1. c4 *")
    g4 = snapshots.delete(spark, at, g3, 1)
    assert sorted((r["number"], r["tags"]["White"], r["movetext"]) for r in snapshots.read(spark, at).collect()) == [(1, "B2", "1. c4 *"), (2, "C", "1. d4 *")]
    with pytest.raises(snapshots.GenerationChanged):
        snapshots.delete(spark, at, g3, 1)
    with pytest.raises(snapshots.NoSuchGame):
        snapshots.delete(spark, at, g4, 9)


def test_incremental_counts(spark, tmp_path, plies, games):
    visited = explorer.visits(plies).join(games.select("number", "outcome"), "number").select("number", "pos_key", "ply", "move", "outcome")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        visited.where(F.col("number") % 2 == i).coalesce(1).write.mode("append").parquet(src)
        counts.follow(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(f"{out}/b000000001")
    assert sorted(map(tuple, got.select("pos_key", "games", "white", "draws", "black").collect())) == sorted(map(tuple, counts.counts(visited).select("pos_key", "games", "white", "draws", "black").collect()))


def time_control(tag):
    """The rule, in plain Python: the first period's seconds and a minute per second of increment."""
    t = tag.strip()
    if t == "-":
        return 0x80
    head = t.split(":")[0].removeprefix("*")
    moves, slash, rest = head.partition("/") if "/" in head else ("", "", head)
    base, plus, inc = rest.partition("+")
    if not all(x.isdigit() and len(x) < 10 for x, needed in ((moves, slash), (base, "x"), (inc, plus)) if needed):
        return 0
    base, inc = int(base), int(inc or 0)
    if inc >= 3600 or slash and int(moves) and base / int(moves) >= 3600:
        return 0x80
    total = base + 60 * inc
    return 0x20 if 0 < total <= 600 else 0x40 if 0 < total < 3600 else 0


def time_control_tags():
    r = random.Random(31)
    out = ["", "-", "?", " - ", "an hour", "7/", "+9", "1234567890"]
    for base in (1, 59, 599, 600, 601, 3599, 3600, 3601, 86400, *(r.randint(1, 9000) for _ in range(12))):
        out += [f"{base}", f"*{base}", f"{base}+{r.randint(0, 40)}", f"{r.randint(1, 60)}/{base}", f"{r.randint(1, 60)}/{base}:{r.randint(60, 3600)}"]
    return [*out, "1/90000", "10+3700"]


def test_scalars(spark):
    tags = time_control_tags()
    t = spark.createDataFrame([(k,) for k in tags], "tag string")
    assert {r["tag"]: r["b"] for r in t.select("tag", scalars.time_control_bits(F.col("tag")).alias("b")).collect()} == {k: time_control(k) for k in tags}
    row = spark.range(1).select(
        scalars.clean_comment(F.lit(" a {b}\n\t c ")).alias("c"),
        scalars.base64url(F.lit("???>")).alias("b"),
        scalars.percent_encoded(F.lit("a b~c+é")).alias("p"),
        scalars.split_name(F.lit("Last , First, Jr"))[1].alias("f"),
        scalars.eco_text(F.lit(128 * 253)).alias("e"),
        scalars.eco_text(F.lit(64576)).alias("n"),
    ).first()
    assert tuple(row) == ("a (b) c", "Pz8_Pg", "a%20b~c%2B%C3%A9", "First, Jr", "C52", None)


def test_code_pages():
    assert codepages.decode("Иванов, Пётр".encode("cp1251")) == "Иванов, Пётр"
    assert codepages.decode("Müller, Jürgen".encode("cp1252")) == "Müller, Jürgen"
    assert codepages.decode("Müller".encode()) == "Müller" and codepages.decode(None) is None


def test_links(spark):
    games = spark.createDataFrame([(3, "game", "A  B", "C", "E"), (1, "text", "A B", "C", "E"), (2, "game", "X", "C", "E")], "number int, kind string, white string, black string, event string")
    ln = spark.createDataFrame([(1, " A B", None, ""), (2, "", "C", ""), (3, "", "", ""), (4, "X", "C", "E"), (5, "X", "D", "")], "link_id int, white string, black string, event string")
    assert sorted((r["link_id"], r["number"]) for r in links.game_links(ln, games).collect()) == [(1, 3), (2, 2), (4, 2)]


def test_interrupted_and_concurrent_edits(spark, tmp_path):
    path = str(tmp_path / "games")
    games = spark.createDataFrame([(1, {"White": "A"}, "1. e4 *"), (2, {"White": "B"}, "1. d4 *")], "number int, tags map<string,string>, movetext string")
    assert snapshots.create(games, path) == 1
    (tmp_path / "games" / "draft-dead").mkdir()  # a job that died halfway
    (tmp_path / "games" / "draft-dead" / "part-0.parquet").write_bytes(b"half")
    assert snapshots.delete(spark, path, 1, 1) == 2
    with pytest.raises(snapshots.GenerationChanged):
        snapshots.delete(spark, path, 1, 2)
    late = tmp_path / "games" / "g000000003"  # another writer gets there between check and rename
    late.mkdir()
    with pytest.raises(snapshots.GenerationChanged):
        snapshots.delete(spark, path, 2, 1)
    assert not any(x.name != "draft-dead" and x.name.startswith("draft-") for x in (tmp_path / "games").iterdir())
    assert [(r["number"], r["tags"]["White"]) for r in snapshots.read(spark, path).collect()] == [(1, "B")]
