"""Move trees, their annotations, and verification."""

from ranksmith.operators import verify
from ranksmith.sources import movetree, pgn, synthetic

TEXT = "{start [%csl Ga1]} 1. e4 $1 {best [%cal Ge2e4,Rd7d5,zz] by test} e5 (1... c5 2. Nf3 (2. c3 d5 {sharp}) 2... d6) (1... e6) 2. Nf3!? Nc6 $14 3. Bb5 {[%eval 0.31] [%emt 0:00:05]} 1-0"


def test_parse_and_render_round_trip():
    nodes, result = movetree.parse(TEXT)
    assert result == "1-0" and [n.san for n in nodes if n.main][1:] == ["e4", "e5", "Nf3", "Nc6", "Bb5"]
    assert [(n.san, nodes[n.parent].san, n.ply) for n in nodes if not n.main] == [("c5", "e4", 2), ("Nf3", "c5", 3), ("c3", "c5", 3), ("d5", "c3", 4), ("d6", "Nf3", 4), ("e6", "e4", 2)]
    assert nodes[1].nags == [1] and nodes[1].before.startswith("start") and "best" in nodes[1].after
    text = movetree.render(nodes, result)
    again, _ = movetree.parse(text)
    assert again == sorted(again, key=lambda n: 0) and movetree.render(again, result) == text
    assert {(n.uci, n.ply, n.main, n.before, n.after, tuple(n.nags)) for n in again} == {(n.uci, n.ply, n.main, n.before, n.after, tuple(n.nags)) for n in nodes}
    assert "(1... c5 2. Nf3 (2. c3 d5 {sharp}) 2... d6)" in text


def test_lenient():
    nodes, result = movetree.parse("1. e4 (1. Qh9 e5) 1... e5 2. -- Nc6 {unclosed")
    assert [n.san for n in nodes[1:]] == ["e4", "e5"] and result == "*"
    assert movetree.parse("", "bad")[0] == [movetree.Node(-1, 0)]
    assert movetree.commands("a [%csl Ga1,Xb2] b") == ("a b", [("csl", "Ga1")])


def test_annotations(spark):
    games = spark.createDataFrame([(1, {"Event": "x"}, TEXT), (2, {"Event": "y"}, None)], "number int, tags map<string,string>, movetext string")
    tree = movetree.trees(games).cache()
    assert tree.where("number = 1").count() == 12 and tree.where("number = 2").count() == 1
    got = {(r["node"], r["kind"], r["value"]) for r in movetree.annotations(tree).collect()}
    assert {(1, "before", "start"), (1, "after", "best by test"), (1, "nag", "1"), (1, "csl", "Ga1"), (1, "cal", "Ge2e4"), (1, "cal", "Rd7d5")} <= got
    assert {k for _, k, _ in got} == {"before", "after", "nag", "csl", "cal", "eval", "emt"}


def test_random_trees_round_trip():
    import random

    r = random.Random(6)
    for k in range(30):
        line = synthetic.game(k + 1, 10)
        from ranksmith.functions.chess import START, Board

        board, nodes = Board.from_fen(START), [movetree.Node(-1, 0)]
        boards, at = [board], 0
        for u in line:
            m = boards[at].from_uci(u)
            nodes.append(movetree.Node(at, nodes[at].ply + 1, boards[at].san(m), boards[at].uci(m), True, "", r.choice(["", "c"]), r.choice([[], [3]])))
            boards.append(boards[at].played(m))
            main = len(nodes) - 1
            if r.random() < 0.4:
                alt = [x for x in boards[at].legal() if boards[at].uci(x) != u]
                v = at
                for _ in range(r.randint(1, 3)):
                    x = r.choice(alt if v == at else boards[v].legal())
                    nodes.append(movetree.Node(v, nodes[v].ply + 1, boards[v].san(x), boards[v].uci(x), False, r.choice(["", "b"]) if v == at else "", ""))
                    boards.append(boards[v].played(x))
                    v = len(nodes) - 1
            at = main
        assert movetree.parse(movetree.render(nodes))[0] == nodes


def test_verify(spark):
    games = spark.createDataFrame([(1, None, "1. e4 e5 2. Qh5 Nc6 3. Bc4 Nf6 4. Qxf7# 1-0"), (2, {"FEN": "4k3/P7/8/8/8/8/8/R3K3 w Q - 0 1"}, "1. a8=Q+ Kd7 2. O-O-O+ *"), (3, None, "1. e5 *")], "number int, tags map<string,string>, movetext string")
    lines = pgn.lines(games).cache()
    assert verify.line_counts(lines).first().asDict() == {"games": 3, "setups": 1, "plies": 10, "castlings": 1, "promotions": 1, "promotion_captures": 0, "mates": 1, "failures": 1}
    assert [tuple(r) for r in verify.failures(lines).collect()] == [(3, 0)]
