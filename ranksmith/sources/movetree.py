"""Move trees with variations, comments and signs.

A tree is a list of nodes in the order of the text; node 0 is the start. Comments carry text and
commands in brackets: coloured squares (%csl) and arrows (%cal), evaluations (%eval), clock and
time spent (%clk, %emt). A move that can't be read ends its line, not the tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chess import START, BadPosition, Board

_TOKEN = re.compile(r"\{([^}]*)\}?|;([^\n]*)|\$(\d+)|([()])|(1-0|0-1|1/2-1/2|\*)(?=[\s{}();]|$)|\d+\.+|([^\s{}();$]+)")
_COMMAND = re.compile(r"\[%(\w+)\s+([^\]]*)\]")
_SIGNS = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
_SQUARES = {"csl": re.compile(r"([GRYBCO])([a-h][1-8])$"), "cal": re.compile(r"([GRYBCO])([a-h][1-8])([a-h][1-8])$")}


@dataclass
class Node:
    parent: int
    ply: int
    san: str = ""
    uci: str = ""
    main: bool = True
    before: str = ""
    after: str = ""
    nags: list[int] = field(default_factory=list)


def parse(movetext: str, fen: str | None = None) -> tuple[list[Node], str]:
    """(nodes, result)."""
    try:
        boards = [Board.from_fen(fen or START)]
    except BadPosition:
        return [Node(-1, 0)], "*"
    nodes, cur, stack, lost, result = [Node(-1, 0)], 0, [], [False], "*"
    pending, fresh = "", True  # a comment before the next move; at a line's beginning
    for m in _TOKEN.finditer(movetext):
        comment, rest, nag, bracket, end, san = m.groups()
        if bracket == "(":
            stack.append(cur)
            cur = max(nodes[cur].parent, 0)
            lost.append(lost[-1])
            fresh = True
        elif bracket == ")":
            if stack:
                cur = stack.pop()
                lost.pop()
            fresh, pending = False, ""
        elif comment is not None or rest is not None:
            text = re.sub(r"\s+", " ", comment if comment is not None else rest).strip()
            if lost[-1] or not text:
                continue
            if fresh:
                pending = f"{pending} {text}".strip()
            else:
                nodes[cur].after = f"{nodes[cur].after} {text}".strip()
        elif nag:
            if not lost[-1] and cur:
                nodes[cur].nags.append(int(nag))
        elif end and not stack:
            result = end
        elif san and not lost[-1]:
            x = re.match(r"(?:\d+\.+)?(.*?)([!?]*)$", san)
            if not x[1]:
                if x[2] in _SIGNS and cur:
                    nodes[cur].nags.append(_SIGNS[x[2]])
                continue
            move = boards[cur].from_san(x[1])
            if move is None:
                lost[-1] = True
                continue
            n = Node(cur, nodes[cur].ply + 1, boards[cur].san(move), boards[cur].uci(move), not stack and nodes[cur].main, pending)
            n.nags += [_SIGNS[x[2]]] if x[2] in _SIGNS else []
            boards.append(boards[cur].played(move))
            nodes.append(n)
            cur, pending, fresh = len(nodes) - 1, "", False
    if pending:
        nodes[cur].after = f"{nodes[cur].after} {pending}".strip()
    return nodes, result


def render(nodes: list[Node], result: str = "*", first_move: int = 1, black_first: bool = False) -> str:
    """Movetext of a tree: a line's variations follow the move they replace."""
    children: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        if i:
            children.setdefault(n.parent, []).append(i)
    out: list[str] = []

    def move(i: int, number: bool) -> None:
        n = nodes[i]
        half = n.ply - 1 + black_first
        if n.before:
            out.append("{" + n.before + "}")
        if half % 2 == 0:
            out.append(f"{first_move + half // 2}. {n.san}")
        else:
            out.append((f"{first_move + half // 2}... " if number or n.before else "") + n.san)
        out.extend(f"${x}" for x in n.nags)
        if n.after:
            out.append("{" + n.after + "}")

    def line(at: int, number: bool) -> None:
        """Writes the line from at on; recursion goes by variations only, not by moves."""
        while at in children:
            kids = children[at]
            move(kids[0], number)
            number = bool(nodes[kids[0]].after)
            for v in kids[1:]:
                out.append("(")
                move(v, True)
                line(v, bool(nodes[v].after))
                out.append(")")
                number = True
            at = kids[0]

    if nodes and nodes[0].after:
        out.append("{" + nodes[0].after + "}")
    line(0, True)
    return re.sub(r"\( | \)", lambda m: m[0].strip(), " ".join([*out, result]))


def commands(comment: str) -> tuple[str, list[tuple[str, str]]]:
    """(plain text, (command, argument) pairs); unreadable squares and arrows are left out."""
    found = []
    for name, args in _COMMAND.findall(comment):
        form = _SQUARES.get(name)
        if form:
            found += [(name, a.strip()) for a in args.split(",") if form.match(a.strip())]
        else:
            found.append((name, args.strip()))
    return re.sub(r"\s+", " ", _COMMAND.sub(" ", comment)).strip(), found


TREE = "number int, node int, parent int, ply int, san string, uci string, main boolean, nags array<int>, before string, after string"


def trees(games: DataFrame) -> DataFrame:
    """One row a node of the games (number, tags, movetext)."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]
            for number, fen, text in zip(*(c.to_pylist() for c in b.columns)):
                for i, n in enumerate(parse(text or "", fen)[0]):
                    for c, x in zip(cols, (number, i, n.parent, n.ply, n.san, n.uci, n.main, n.nags, n.before, n.after)):
                        c.append(x)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in TREE.split(", ")])

    return games.select("number", F.trim(F.col("tags")["FEN"]).alias("fen"), "movetext").mapInArrow(run, TREE)


def annotations(tree: DataFrame) -> DataFrame:
    """(number, node, seq, kind, value): comment texts, signs and commands of every node, in
    DataFrame functions."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[%\w+\s+[^\]]*\]", " "), r"\s+", " "))
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value")) if isinstance(kind, str) else F.struct(kind.alias("kind"), value.alias("value"))
    both = F.concat_ws(" ", "before", "after")

    def listed(name: str) -> Column:
        args = F.flatten(F.transform(F.regexp_extract_all(both, F.lit(r"\[%" + name + r"\s+([^\]]*)\]"), 1), lambda a: F.split(a, r"\s*,\s*")))
        return F.transform(F.filter(args, lambda a: a != ""), lambda a: item(name, F.trim(a)))

    every = F.concat(
        F.filter(F.array(item("before", plain(F.col("before"))), item("after", plain(F.col("after")))), lambda x: x["value"] != ""),
        F.transform("nags", lambda n: item("nag", n.cast("string"))),
        *(listed(k) for k in ("csl", "cal", "eval", "clk", "emt")),
    )
    out = tree.select("number", "node", F.posexplode(every).alias("seq", "x"))
    return out.select("number", "node", "seq", "x.kind", "x.value")
