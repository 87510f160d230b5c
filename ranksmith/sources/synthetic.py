"""Generated games (B10): an opening of a small book, played for a while, and then random moves
that favour captures, checks and the centre. Game n is the same in every run."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.chess import START, Board

#: Openings by name, the popular ones first.
BOOK = {
    "Italian": "e2e4 e7e5 g1f3 b8c6 f1c4 f8c5 c2c3 g8f6 d2d3 d7d6",
    "Queen's Gambit Declined": "d2d4 d7d5 c2c4 e7e6 b1c3 g8f6 c1g5 f8e7 e2e3 e8g8",
    "Najdorf": "e2e4 c7c5 g1f3 d7d6 d2d4 c5d4 f3d4 g8f6 b1c3 a7a6",
    "Caro-Kann": "e2e4 c7c6 d2d4 d7d5 e4e5 c8f5 g1f3 e7e6 f1e2 c6c5",
    "King's Indian": "d2d4 g8f6 c2c4 g7g6 b1c3 f8g7 e2e4 d7d6 g1f3 e8g8",
    "English": "c2c4 e7e5 b1c3 g8f6 g1f3 b8c6 g2g3 d7d5 c4d5 f6d5",
}
_LINES = [line.split() for line in BOOK.values()]
_CENTRE = frozenset("c3 c4 c5 c6 d3 d4 d5 d6 e3 e4 e5 e6 f3 f4 f5 f6".split())


def _appeal(b: Board, m) -> int:
    """How likely a move is against a quiet one at the edge."""
    return 1 + 4 * (b.cells[m[1]] != ".") + 2 * (b.uci(m)[2:4] in _CENTRE) + 6 * b.played(m).check()


def game(number: int, plies: int) -> list[str]:
    r = random.Random(number)
    line = r.choices(_LINES, range(len(_LINES), 0, -1))[0]
    b, out = Board.from_fen(START), []
    for text in line[: min(plies, r.randint(2, len(line)))]:
        out.append(text)
        b = b.played(b.from_uci(text))
    while len(out) < plies and (legal := b.legal()):
        m = r.choices(legal, [_appeal(b, m) for m in legal])[0]
        out.append(b.uci(m))
        b = b.played(m)
    return out


def games(spark: SparkSession, n: int, plies: int = 24) -> DataFrame:
    """(number, start_fen, ucis) of games 1..n."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.nulls(len(ids), pa.string()), pa.array([game(i, plies) for i in ids], pa.list_(pa.string()))], names=["number", "start_fen", "ucis"])

    return spark.range(1, n + 1).selectExpr("cast(id as int) number").mapInArrow(run, "number int, start_fen string, ucis array<string>")
