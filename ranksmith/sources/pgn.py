"""PGN text files: a distributed reader, replay, and an order-preserving writer (S7-S9, S12, S17,
S20, S21, F33, F34, F37, R3, W6).

Files are split at lines that begin `[Event "`, by Spark's own record reader with that as the
line separator, so a 10 GB file is many splits and no file is read whole. A piece may still
hold several games (a repeated tag starts one); the parser cuts those. An unclosed comment thus
ends before the next such line.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.chess import START, BadPosition, Board
from ..operators.fragment import BOARDS

_SEPARATOR = '\n[Event "'
_TAG = re.compile(r'\s*\[\s*([A-Za-z0-9_]+)\s+"((?:\\.|[^"\\\n])*)"?\s*\]?')
_TOKEN = re.compile(r"\{[^}]*\}?|;[^\n]*|\$\d+|[()]|1-0|0-1|1/2-1/2|\*|\d+\.(?:\.\.)?|\.+|[^\s{}();$]+")
MAX_PLIES, MAX_TAG = 65_535, 4096


def games_of(text: str) -> list[tuple[dict[str, str], str]]:
    """(tags, movetext) of each game in a piece of PGN."""
    out: list[tuple[dict[str, str], str]] = []
    tags: dict[str, str] = {}
    start = at = 0
    moves_from = None
    for line in re.finditer(r"[^\r\n]*(?:\r\n|\n|\r|$)", text):
        if line.start() < at or not line[0]:
            continue
        m = _TAG.match(text, line.start()) if line[0].lstrip().startswith("[") else None
        body = text[start : line.start()] if moves_from is not None else ""
        if m and body.count("{") <= body.count("}"):
            if moves_from is not None and body.strip() or m[1] in tags:
                out.append((tags, body.strip()))
                tags = {}
            moves_from = None
            if len(m[2]) <= MAX_TAG:
                tags[m[1]] = re.sub(r"\\(.)", r"\1", m[2])
            at = start = line.end()
        elif moves_from is None and line[0].strip() and not line[0].startswith("%"):
            moves_from = start = line.start()
    body = text[start:] if moves_from is not None else ""
    if tags or body.strip():
        out.append((tags, body.strip()))
    return out


def sans_of(movetext: str) -> tuple[list[str], str]:
    """Main-line moves as written, and the closing result (`*` if there is none)."""
    depth, out, result = 0, [], "*"
    for m in _TOKEN.finditer(movetext):
        t = m[0]
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif depth or t[0] in "{;$." or re.fullmatch(r"\d+\.*", t):
            continue
        elif t in ("1-0", "0-1", "1/2-1/2", "*"):
            result = t
        else:
            t = re.sub(r"^\d+\.+", "", t)
            if t and not re.fullmatch(r"[!?]+", t):
                out.append(t)
    return out, result


def replay(fen: str | None, sans: list[str]):
    """(boards, moves): the line up to the first illegal, ambiguous or null move."""
    try:
        b = Board.from_fen(fen or START)
    except BadPosition:
        return [], []
    boards, moves = [b], []
    for s in sans[:MAX_PLIES]:
        m = b.from_san(s)
        if m is None:
            break
        moves.append(m)
        b = b.played(m)
        boards.append(b)
    return boards, moves


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(number, tags, movetext) of the games of all files under path, in file order."""
    raw = spark.read.option("lineSep", _SEPARATOR).option("recursiveFileLookup", "true").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))

    def run(batches):
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for text, file, split, at in zip(*(c.to_pylist() for c in b.columns)):
                text = text.lstrip("\ufeff")
                if not re.match(r"\s*\[", text) and re.match(r'(?:\\.|[^"\\\n])*"\s*\]', text):
                    text = _SEPARATOR[1:] + text  # the separator took the tag's beginning
                for i, (tags, moves) in enumerate(games_of(text)):
                    for c, x in zip(cols, (file, split, at, i, list(tags.items()), moves)):
                        c.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "split", "at", "i", "tags", "movetext"])

    games = raw.mapInArrow(run, "file string, split bigint, at bigint, i int, tags map<string,string>, movetext string")
    # Numbers: rank within a split, and before it the games of the splits that come first.
    per = games.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "split", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "split").orderBy("at", "i"))
    return games.withColumn("rank", rank).join(per, ["file", "split"]).select((F.col("rank") + F.col("before")).cast("int").alias("number"), "tags", "movetext")


def records(games: DataFrame) -> DataFrame:
    """Normalised header fields of games (number, tags, movetext)."""
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    known = lambda k: F.when(scalars.unknown(tag(k)), "").otherwise(F.trim(tag(k)))
    y, m, d = (scalars.pgn_date(tag("Date"), p) for p in "ymd")
    r, s = scalars.pgn_round(tag("Round")), scalars.pgn_round(tag("Round"), True)
    variant = F.lower(tag("Variant"))
    eco = F.upper(F.trim(tag("ECO")))
    return games.select(
        "number",
        F.lit("game").alias("kind"),
        F.lit(False).alias("deleted"),
        F.contains(variant, F.lit("960")).alias("chess960"),
        known("White").alias("white"),
        known("Black").alias("black"),
        known("Event").alias("event"),
        known("Site").alias("place"),
        known("Annotator").alias("annotator"),
        scalars.result_text(tag("Result")).alias("result"),
        F.when(eco.rlike("^[A-E][0-9]{2}"), F.left(eco, F.lit(3))).alias("eco"),
        y.alias("y"),
        m.alias("m"),
        d.alias("d"),
        scalars.date_text(y, m, d).alias("date_text"),
        r.alias("round"),
        s.alias("subround"),
        scalars.round_text(r, s).alias("round_text"),
        scalars.rating(tag("WhiteElo")).alias("white_elo"),
        scalars.rating(tag("BlackElo")).alias("black_elo"),
        scalars.time_control_bits(tag("TimeControl")).cast("int").alias("tc"),
        F.when(F.col("tags").getItem("FEN").isNotNull(), F.trim(tag("FEN"))).alias("start_fen"),
    )


LINE = "number int, start_fen string, ucis array<string>, sans array<string>, complete boolean"


def lines(games: DataFrame) -> DataFrame:
    """The replayed main line of every game; complete if no move was left unread."""

    def run(batches):
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for number, fen, text in zip(*(c.to_pylist() for c in b.columns)):
                sans, _ = sans_of(text or "")
                boards, moves = replay(fen, sans)
                row = (number, fen, [x.uci(m) for x, m in zip(boards, moves)], [x.san(m) for x, m in zip(boards, moves)], len(moves) == len(sans) and bool(boards))
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["number", "start_fen", "ucis", "sans", "complete"])

    return games.select("number", F.trim(F.col("tags")["FEN"]).alias("fen"), "movetext").mapInArrow(run, LINE)


def lines_of_ucis(lines_: DataFrame) -> DataFrame:
    """(number, start_fen, ucis, sans) of lines given in UCI."""

    def run(batches):
        for b in batches:
            sans = []
            for fen, ucis in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                board, out = Board.from_fen(fen or START), []
                for u in ucis:
                    m = board.from_uci(u)
                    out.append(board.san(m))
                    board = board.played(m)
                sans.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sans, pa.list_(pa.string()))], names=["number", "start_fen", "ucis", "sans"])

    return lines_.select("number", "start_fen", "ucis").mapInArrow(run, "number int, start_fen string, ucis array<string>, sans array<string>")


def plies(lines_: DataFrame) -> DataFrame:
    """One row a position of each line: key, move played next (UCI), move number, bitboards."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5 + len(BOARDS))]
            for number, fen, ucis in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    board = Board.from_fen(fen or START)
                except BadPosition:
                    continue
                for ply, uci in enumerate([*ucis, None]):
                    for c, x in zip(cols, (number, ply, board.key(), uci, board.move, *board.bitboards())):
                        c.append(x)
                    if uci is not None:
                        board = board.played(board.from_uci(uci))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32()] + [pa.int64()] * len(BOARDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["number", "ply", "pos_key", "move", "move_number", *BOARDS])

    schema = "number int, ply int, pos_key bigint, move string, move_number int, " + ", ".join(f"{b} bigint" for b in BOARDS)
    return lines_.select("number", "start_fen", "ucis").mapInArrow(run, schema)


ROSTER = ("Event", "Site", "Date", "Round", "White", "Black", "Result")


def render(tags: Column, sans: Column, result: Column, first_move: int = 1) -> Column:
    """PGN text of one game, wrapped at 80 columns; native, for games from the start position."""
    quote = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = lambda k, v: F.concat(F.lit("["), k, F.lit(' "'), quote(v), F.lit('"]\n'))
    head = F.concat(*(line(F.lit(k), F.coalesce(tags[k], F.lit("?") if k != "Result" else result)) for k in ROSTER))
    rest = F.array_sort(F.filter(F.map_entries(tags), lambda e: ~e["key"].isin(*ROSTER)))
    more = F.array_join(F.transform(rest, lambda e: line(e["key"], e["value"])), "")
    numbered = F.transform(sans, lambda s, i: F.when(i % 2 == 0, F.concat((i / 2 + first_move).cast("int").cast("string"), F.lit(". "), s)).otherwise(s))
    text = F.concat_ws(" ", F.array_join(numbered, " "), result)
    return F.concat(head, more, F.lit("\n"), F.trim(F.regexp_replace(text, r"(.{1,79})(?:\s+|$)", "$1\n")), F.lit("\n"))


def write(games: DataFrame, path: str, parts: int) -> None:
    """games (number, pgn) as text files whose names are in number order."""
    games.repartitionByRange(parts, "number").sortWithinPartitions("number").select("pgn").write.text(path)
