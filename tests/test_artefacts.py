"""Stored artefacts, lists of databases, signs and the small record functions."""

import os
import zlib

from pyspark.sql import functions as F

from ranksmith.functions import scalars, signs
from ranksmith.operators import explorer, search, verify
from ranksmith.plans import store
from ranksmith.sources import databases


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_an_artefact_follows_its_input(spark, tmp_path):
    table = str(tmp_path / "t.parquet")
    made = []

    def get():
        def make():
            made.append(1)
            return spark.read.parquet(table).select("id")

        return sorted(r["id"] for r in store.stored(spark, str(tmp_path), "a", ("t",), make, ("id",)).collect())

    spark.range(5).write.parquet(table)
    assert get() == get() == list(range(5)) and len(made) == 1
    spark.range(5, 8).write.mode("append").parquet(table)
    assert get() == list(range(8)) and len(made) == 2


def test_folders_are_read_breadth_first_and_within_a_bound(spark, tmp_path):
    for name in ("top.pgn", "b/in.CBH", "b/deep/x.2cbh", "a/y.pgn", ".hid/z.pgn", "b/notes.txt"):
        at = tmp_path / "root" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("")
    (tmp_path / "root/folder.pgn").mkdir()
    os.symlink(tmp_path / "root/b", tmp_path / "root/again")
    root = str(tmp_path / "root")
    short = lambda found: [f[len(root) + 1 :] for f in found]
    found, cut = databases.expand(spark, root)
    assert short(found) == ["a/y.pgn", "b/deep/x.2cbh", "b/in.CBH", "top.pgn"] and not cut
    found, cut = databases.expand(spark, root, 3)
    assert short(found) == ["a/y.pgn", "b/in.CBH", "top.pgn"] and cut
    assert databases.expand(spark, root + "/none.pgn") == ([root + "/none.pgn"], False)
    rows = databases.listing(spark, root + "/b/in.CBH", root).collect()
    assert [(r["name"], r["list"]) for r in rows] == [("in", 0), ("y", 1), ("x", 1), ("top", 1)]


def test_signs(spark):
    read = lambda s: one(spark, s, signs.signs_read)
    assert read("a \ue029 on h4 \ue00a") == "a ♙ on h4 ±"
    assert read("\ue005see \ue006") == "see \ue006"
    assert read("л\ue008блю, \ue007лля, н\ue009") == "люблю, Ілля, нч"
    assert read("мат \ue008 ") == "мат ⯽ "
    assert read("×ёрный ×e4 К×е4") == "Чёрный ×e4 К×е4"
    m = "\ue02d"
    assert read(f"{m}StartSQUARE{m * 3}k{m}endsquare{m}") == "[k]"
    assert read(f"{m}LinkStart{m}u{m}linkend{m} {m}Other{m}") == f"u {m}Other{m}"
    assert read(f"я{m}linkstart{m}\ue008") == "я⯽"  # neighbours are those of the text as stored
    assert read(m * 100_000) == m * 100_000
    comment = lambda s: one(spark, s, lambda c: signs.layout_read(c, "@", 2))
    assert comment("@@startfen@@8/8@@endfen@@ @startfen@ @@x@@") == "[FEN 8/8] @startfen@ @@x@@"
    assert read("") == "" and read(None) is None


def test_languages(spark):
    code = lambda n: one(spark, n, signs.language_code, "int")
    assert [code(n) for n in (0, 7, 8, 18, 255, 256, 300)] == ["en", "any", "cb-l8", "el", "cb-l255", "cb-0", "cb-44"]
    number = lambda s: one(spark, s, signs.language_number)
    assert [number(s) for s in ("EN", "pl", "any", "xx")] == [0, 12, None, None]


def test_record_values(spark):
    code = lambda s: one(spark, s, scalars.move_code)
    assert code("b1c3") == 1 + 64 * 18 and code("a7a8q") == 48 + 64 * 56 and code("a7a8n") == 48 + 64 * 56 + 3 * 4096 and code(None) == 0
    spent = lambda b: tuple(spark.createDataFrame([(bytearray(b),)], "x binary").select(*scalars.time_spent(F.col("x"))).first())
    assert spent(b"\x00\x05\x3b\x02") == (2, 59, 5) and spent(b"\x00\x3c\x00\x00") == (None,) * 3 and spent(b"\x00\x01\x01") == (None,) * 3
    raw = b"a line of a file"
    assert one(spark, bytearray(raw), lambda c: scalars.digests(c)[0], "binary") == zlib.crc32(raw)


def test_move_orders(spark):
    v = spark.createDataFrame([(1, 0, 0, "g1f3", "white"), (2, 0, 0, "e2e4", "draw"), (3, 0, 0, None, "black")], "number int, pos_key long, ply int, move string, outcome string")
    order = lambda **k: [r["move"] for r in explorer.move_counts(v, **k).orderBy("rank").collect()]
    assert order() == ["g1f3", "e2e4"]
    assert order(code=scalars.move_code(F.col("move"))) == ["g1f3", "e2e4"]
    assert order(code=-scalars.move_code(F.col("move"))) == ["e2e4", "g1f3"]


def test_departures_and_readable_records(spark):
    may = lambda gone, home: spark.createDataFrame([(gone,)], "x array<int>").select(explorer.allows(F.col("x"), home).alias("y")).first()["y"]
    full = 0xFFFF
    assert may([], full) and may([12, 4], full) and may([4, 12, 3], full & ~(1 << 12 | 1 << 4))
    assert not may([4], full & ~(1 << 12 | 1 << 4)) and not may([3, 4, 12], full & ~(1 << 12 | 1 << 4))
    g = spark.createDataFrame([(1, True, 10), (2, False, 10), (3, True, (2 << 20) + 1), (4, True, 2 << 20)], "number int, readable boolean, record_bytes int")
    g = g.select("*", F.lit("game").alias("kind"), F.lit(False).alias("deleted"), F.lit(False).alias("chess960"))
    assert sorted(r["number"] for r in explorer.eligible(g).collect()) == [1, 4]


def test_counts_of_nothing(spark):
    none = spark.createDataFrame([], "state string")
    assert set(verify.state_counts(none).first()) == {0}
    assert verify.latencies(spark.createDataFrame([("a", None)], "l string, v double"), "l", "v").count() == 0
    t = spark.createDataFrame([("a", float(v)) for v in range(20)], "l string, v double")
    assert tuple(verify.latencies(t, "l", "v").first()) == ("a", 20, 10.0, 19.0, 19.0)


def test_heads_tell_what_does_not_fit(spark):
    cols = "number int, kind string, deleted boolean, white_id long, black_id long, tournament_id long, annotator_id long, white_elo int, black_elo int, round int, subround int, moves int, y int, m int, d int, eco string, result string"
    row = lambda n, kind="game", white=1, elo=0, moves=1: (n, kind, False, white, None, 3, None, elo, 0, 0, 0, moves, 0, 0, 0, None, "*")
    df = spark.createDataFrame([row(1), row(2, white=1 << 31), row(3, elo=40_000), row(4, "text", white=1 << 40, moves=99_999), row(5, "analysis", moves=99_999)], cols)
    assert {r["number"]: r["fits"] for r in search.heads(df).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
