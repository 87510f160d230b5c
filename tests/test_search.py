"""The grammar and the search over a ten-record collection, against a plain matcher."""

import random
from collections import Counter

import pytest

from ranksmith.operators import search, suggest
from ranksmith.plans import grammar

FIRST = ("Ada", "Bela", "Ciro", "Dana", "ada")
LAST = ("Okafor", "Quist", "Varga", "Zamora", "okafor")
EVENTS = ("Lakeside Open", "Night Ladder", "Rook and Pawn Cup", "lakeside open")
CLASSES = ("normal", "blitz", "rapid", "corr")


def _records(seed=17, n=36):
    """number, kind, white, black, event, date, round, result, eco, moves, elos, annotator, time
    control: games, deleted ones and texts, with unknown parts, ties and names equal but for case."""
    r = random.Random(seed)
    people = [f"{a}, {b}" for a in LAST for b in FIRST][:: r.randint(2, 3)]
    out = []
    for i in range(1, n + 1):
        kind = r.choices(("game", "deleted", "text"), (8, 1, 2))[0]
        y = r.choice((0, 1974, 1988, 2003))
        m = r.randint(1, 12) if y and r.random() < 0.8 else 0
        date = (y, m, r.randint(1, 28) if m and r.random() < 0.8 else 0)
        if kind == "text":
            out.append((i, "text", "", "", r.choice(EVENTS), (0, 0, 0), (0, 0), "*", None, 0, 0, 0, "", None))
            continue
        rd = r.choice(((0, 0), (r.randint(1, 12), 0), (r.randint(1, 12), r.randint(1, 3))))
        eco = r.choice((None, f"{r.choice('ABCDE')}{r.randrange(100):02d}"))
        elos = [r.choice((0, r.randint(1200, 2800))) for _ in "wb"]
        out.append((i, kind, r.choice(people), r.choice(people), r.choice(EVENTS), date, rd, r.choice(("1-0", "0-1", "1/2-1/2", "*")), eco, r.randint(1, 90), *elos, r.choice(("", *people[:3])), r.choice(CLASSES)))
    return out


ROWS = _records()
BITS = {"normal": 1, "blitz": 0x20, "rapid": 0x40, "corr": 0x80, None: 0}


def date_text(y, m, d):
    return f"{y or '????'}.{f'{m:02d}' if m else '??'}.{f'{d:02d}' if d else '??'}"


def round_text(r, s):
    return "" if r <= 0 else f"{r}({s})" if s > 0 else str(r)


@pytest.fixture(scope="module")
def db(spark):
    names = sorted({n for r in ROWS for n in (r[2], r[3], r[12]) if n})
    events = sorted({(r[4], BITS[r[13]] & ~1) for r in ROWS if r[1] != "text"})
    ids = {n: i for i, n in enumerate(names)}
    at = {e: i for i, e in enumerate(events)}
    data = []
    for n, kind, w, b, ev, d, rd, res, eco, mv, we, be, ann, tc in ROWS:
        game = kind != "text"
        data.append((n, "game" if game else "text", kind == "deleted", False, ids.get(w), ids.get(b), at.get((ev, BITS[tc] & ~1)) if game else None, ids.get(ann), None if game else ev, res, eco, *d, date_text(*d), *rd, round_text(*rd), we, be, mv, None))
    schema = "number int, kind string, deleted boolean, chess960 boolean, white_id bigint, black_id bigint, tournament_id bigint, annotator_id bigint, title string, result string, eco string, y int, m int, d int, date_text string, round int, subround int, round_text string, white_elo int, black_elo int, moves int, own_time_control int"
    records = spark.createDataFrame(data, schema).cache()
    people = spark.createDataFrame([(i, n) for n, i in ids.items()], "id bigint, name string").cache()
    tours = spark.createDataFrame([(i, e, "", k) for (e, k), i in at.items()], "id bigint, title string, place string, kind int").cache()
    return search.Database(records, people, tours, people)


def cover(v, op, low, high):
    return {"<": v < low, "<=": v <= low + "~", ">": v > low + "~", ">=": v >= low, "..": low <= v <= (high or "") + "~"}[op]


def one(field, v, r):
    import re

    n, kind, w, b, ev, d, rd, res, eco, mv, we, be, ann, tc = r
    low = v.low.lower()
    if field in ("", "white", "black", "player", "event", "annotator"):
        pool = {"": (w, b, ev, ann), "white": (w,), "black": (b,), "player": (w, b), "event": (ev,), "annotator": (ann,)}[field]
        return any(low in x.lower() for x in pool)
    if field == "round":
        return v.low in round_text(*rd)
    if field == "result":
        return res == v.low
    if field == "eco":
        return bool(eco) and (eco.startswith(v.low.upper()) if not v.op else cover(eco, v.op, v.low.upper(), v.high.upper()))
    if field == "date":
        t, form = date_text(*d), re.compile(r"\d{4}([-./]\d{1,2}([-./]\d{1,2})?)?$")
        typed = [".".join(p if i == 0 else p.zfill(2) for i, p in enumerate(re.split("[-./]", x))) if form.match(x) else None for x in (v.low, v.high)]
        if not v.op:
            return t.startswith(typed[0]) if typed[0] else v.low in t
        ends = typed if v.op == ".." else typed[:1]
        return None not in ends and "?" not in t[: max(map(len, ends))] and cover(t, v.op, ends[0], ends[-1])
    if field == "tc":
        bits = {"normal": 0, "blitz": 0x20, "rapid": 0x40, "corr": 0x80, "correspondence": 0x80}.get(low)
        own = BITS[tc] & ~1
        return bits is not None and (own == 0 if bits == 0 else bool(own & bits))
    def number(x):
        try:
            a, z = int(v.low), int(v.high or v.low)
        except ValueError:
            return False
        return {"": x == a, "<": x < a, "<=": x <= a, ">": x > a, ">=": x >= a, "..": a <= x <= z}[v.op]

    if field == "moves":
        return number(mv)
    return any(x > 0 and number(x) for x in {"elo": (we, be), "white_elo": (we,), "black_elo": (be,)}[field])


def brute(text):
    q = grammar.parse(text)
    out = []
    for r in ROWS:
        fields = {t.field for t in q.terms}
        if r[1] == "text" and fields - {"", "event", "annotator"}:
            continue
        if all(any(one(t.field, v, r) for v in t.values) != t.negated for t in q.terms):
            out.append(r)
    key, down = q.sort or ("number", False)
    k = {
        "number": lambda r: r[0], "white": lambda r: r[2].lower(), "black": lambda r: r[3].lower(), "event": lambda r: r[4].lower(), "date": lambda r: r[5],
        "round": lambda r: r[6] if r[6][0] > 0 else (0, 0), "result": lambda r: r[7], "eco": lambda r: r[8] or "", "moves": lambda r: r[9], "white_elo": lambda r: r[10],
        "black_elo": lambda r: r[11], "annotator": lambda r: r[12].lower(),
    }[key]
    return [r[0] for r in sorted(sorted(out), key=k, reverse=down) if True] if not down else [r[0] for r in sorted(sorted(out, key=lambda r: r[0]), key=k, reverse=True)]


def _queries(seed=23):
    """One query and more of every production of the grammar, from values that the records have."""
    r = random.Random(seed)
    names = sorted({w for x in ROWS for w in (x[2] + " " + x[3]).lower().replace(",", "").split()})
    elo = lambda: r.randrange(1200, 2800)
    plain = {
        "": lambda: r.choice(names), "white": lambda: r.choice(names), "black": lambda: r.choice(names).upper(), "player": lambda: f"{r.choice(names)},{r.choice(names)}",
        "event": lambda: r.choice(('"rook and"', "lake", "ladder")), "tournament": lambda: "night", "annotator": lambda: r.choice(names), "round": lambda: r.choice(("1", "2(", '"1(1)"')),
        "result": lambda: r.choice(("1-0", "draw", "½-½", "unknown,0-1")), "eco": lambda: r.choice(("b", "C1", "E,A", "d5")), "date": lambda: r.choice(("1988", "2003-1", "1974/07", "??")),
        "moves": lambda: str(r.choice(ROWS)[9]), "elo": lambda: str(max(r.choice(ROWS)[10], 1)), "whiteElo": lambda: f"{elo()}..{elo()}", "blackelo": lambda: "soon",
        "timecontrol": lambda: r.choice(CLASSES).title(), "tc": lambda: r.choice(("bullet", "blitz,rapid", "correspondence")),
    }
    ranges = {"eco": lambda: r.choice("ABCDE") + str(r.randrange(10)), "date": lambda: r.choice(("1974", "1988-06", "1996", "2003-02-11")), "moves": lambda: str(r.randrange(90)), "elo": lambda: str(elo()), "whiteelo": lambda: str(elo()), "blackelo": lambda: str(elo())}
    out = []
    for field, value in plain.items():
        name = f"{field}:" if field else ""
        out += [name + value(), "-" + name + value(), f"{name}{value()} -event:open"]
    for field, value in ranges.items():
        out += [f"{field}:{op}{value()}" for op in ("<", "<=", ">", ">=")]
        out += [f"{field}:{value()}..{value()}", f"{field}:{value()}..*", f"-{field}:..{value()}", f"{field}:..*"]
    for key in ("number", "white", "black", "whiteElo", "blackElo", "result", "moves", "eco", "tournament", "event", "date", "pgndate", "round", "annotator", "nothing"):
        out += [f"sort:{key}", f"sort:{key}-asc", f"{r.choice(names)} sort:{key}-desc"]
    return [*out, f'"#{names[0]}"', f"#{names[0]}", "Chapter2:ends", f"- {names[1]}", f"elo:>={elo()} elo:<{elo()} -tc:blitz"]


QUERIES = _queries()


def test_corpus(db):
    frames = []
    for i, text in enumerate(["", *QUERIES]):
        found = search.ranked(*search.search(db, text))
        frames.append(found.selectExpr(f"{i} AS q", "number", "rank"))
    for at in range(0, len(frames), 12):
        every = frames[at]
        for f in frames[at + 1 : at + 12]:
            every = every.union(f)
        got = {}
        for r in sorted(every.collect(), key=lambda r: (r["q"], r["rank"])):
            got.setdefault(r["q"], []).append(r["number"])
        for i, text in list(enumerate(["", *QUERIES]))[at : at + 12]:
            want = brute(text)
            assert got.get(i, []) == want, text


@pytest.mark.parametrize("text,name", [("tag:x", "tag"), ("-is:chapter", "is"), ("no:", "no"), ("UPDATED:>1", "updated"), ('has:"a b"', "has")])
def test_refused(text, name):
    with pytest.raises(grammar.UnsupportedQualifier, match=name):
        grammar.parse(text)


def test_limits():
    assert len(grammar.parse(" ".join(f"w{i}" for i in range(50))).terms) == 32
    assert grammar.parse("x" * 300).terms[0].values[0].low == "x" * 256
    assert not grammar.parse(" " * 1024 + "late").terms
    assert grammar.parse("sort:eco sort:date-asc -sort:white sort:nothing").sort == ("date", False)
    assert grammar.parse('player:"a, b",c').terms[0].values == (grammar.Value("", "a, b"), grammar.Value("", "c"))


def test_window(db):
    found, by = search.search(db, "", "date")
    assert [r["number"] for r in search.window(found, by, 2, 3).collect()] == brute("sort:date")[2:5]
    with pytest.raises(grammar.BadRequest, match="limit"):
        search.window(found, by, 0, 501)
    with pytest.raises(grammar.BadRequest, match="sort"):
        search.search(db, "", "nothing")


def test_members_and_rows(db, spark):
    some = [ROWS[i][0] for i in range(0, len(ROWS), 5)]
    members = spark.createDataFrame([(n,) for n in [*some, some[0], 777]], "number int")
    found, by = search.search(db, "-result:0-1", members=members, wanted={"white", "black", "event", "annotator"})
    want = [(r[0], r[2], date_text(*r[5])) for r in ROWS if r[0] in some and r[1] != "text" and r[7] != "0-1"]
    assert sorted((r["number"], r["white"], r["date"]) for r in search.rows(found).collect()) == want


def test_suggest(db):
    def want(cols, prefix):
        n = Counter(x for r in ROWS if r[1] != "text" for x in {r[c] for c in cols} if x)
        hit = [(x, k) for x, k in n.items() if x.lower().startswith(prefix) or cols != (4,) and x.lower().split(", ")[-1].startswith(prefix)]
        return sorted(hit, key=lambda x: (-x[1], x[0].lower(), x[0]))[:20]

    names = lambda f, p: [(r["name"], r["games"]) for r in sorted(suggest.suggest(db, f, p).collect(), key=lambda r: r["rank"])]
    assert names("player", "da") == want((2, 3), "da") != []
    assert names("player", "ok") == want((2, 3), "ok")
    assert names("event", "lake") == want((4,), "lake")
    assert names("annotator", "") == want((12,), "")
