"""Every query against a brute-force version or its SQL, on nulls, ties, repeats and emptiness."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ranksmith.llm import catalog, decontam, html_extract, langid, lm_score, pii, simhash, token_counts

Q = catalog.queries() | {"pipeline": corpus_pipeline.run}


def got(spark, sf_dir, name):
    return [r.asDict() for r in Q[name](spark, sf_dir).collect()]


@pytest.mark.parametrize("name", list(Q))
def test_empty_tables(spark, empty_dir, name):
    assert got(spark, empty_dir, name) == []


def words(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("small", [False, True])
def test_op1(spark, sf_dir, rows, monkeypatch, small):
    if small:  # many blocks, and segments of three tokens
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(lm_score, "SEGMENT", 3)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    order = lm_score.ORDER
    c, reads = Counter(), []
    for i, t, *_ in rows:
        if not held(i):
            seq = ["<s>", *words(t), None]
            for at in range(1, len(seq)):
                for k in range(1, order + 1):
                    if at - k + 1 >= 0:
                        c[tuple(seq[at - k + 1 : at + 1])] += 1
                        reads.append(tuple(seq[at - k + 1 : at + 1]))
    c[("<s>",)] = sum(not held(i) for i, *_ in rows)
    n, v = sum(x for g, x in c.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 for g in c) - 1
    fits, singles = Counter(), Counter()
    for g in reads:
        if len(g) > 1:
            key = len(g) - 1, int(math.log2(c[g[:-1]]))
            fits[key] += 1
            singles[key] += c[g] == 1
    fail = {k: (singles[k] + 0.5) / (fits[k] + 1) for k in fits}

    def p(context, w):
        """The automaton itself: states with arcs and a failure arc to the context without its first."""
        if not context:
            return (c.get((w,), 0) + 0.1) / (n + 0.1 * (v + 1))
        short = p(context[1:], w)
        if not c.get(context):
            return short
        b = fail[len(context), int(math.log2(c[context]))]
        return (1 - b) * c.get((*context, w), 0) / c[context] + b * short

    def score(t):
        seq = ["<s>", *words(t), None]
        return sum(math.log10(p((), w)) for w in seq[1:]), sum(math.log10(p(tuple(seq[max(0, at - order + 1) : at]), seq[at])) for at in range(1, len(seq)))

    assert math.isclose(sum(p(("of", "the"), g[0]) for g in c if len(g) == 1 and g != ("<s>",)) + p(("of", "the"), "unseen"), 1.0)
    out = got(spark, sf_dir, "op1_lm_score")
    want = sorted((i is None, i or 0, held(i), len(words(t)) + 1, sum(c.get((w,), 0) > 0 for w in [*words(t), None]), *score(t)) for i, t, *_ in rows)
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out)
    assert len(have) == len(want)
    for a, b in zip(want, have):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)
    assert {r["train_tokens"] for r in out} == {n}


def test_op2_against_dynamic_programming():
    import random

    r = random.Random(1)
    item = "The quick brown fox jumps over the lazy dog, and then it runs away from the farm again."
    index = decontam.Index([(7, item.encode())], decontam.Q, decontam.RATE)
    fold = lambda s: s.lower().replace("\n", " ")

    def least(p, t):
        prev = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            cur = [i + 1]
            for j, b in enumerate(t):
                cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
        return min(prev)

    import pyarrow as pa

    seen = Counter()
    for _ in range(120):
        s = list(item)
        for _ in range(r.randint(0, 14)):
            p = r.randrange(len(s))
            k = r.random()
            if k < 0.4:
                s[p] = r.choice("xyz Q")
            elif k < 0.7:
                del s[p]
            else:
                s.insert(p, r.choice("xyz\n"))
        text = "".join(r.choice("abc de") for _ in range(r.randint(0, 80))) + "".join(s) + "".join(r.choice("abc de") for _ in range(r.randint(0, 80)))
        e = least(fold(item), fold(text))
        found = decontam.find(index, *decontam.text_buffer(pa.array(["other", text, None, ""])))
        assert found == ([(1, 0, e)] if e <= index.k[0] else [])
        seen[e <= index.k[0]] += 1
    assert min(seen.values()) > 10


def test_op2_of_repetitive_items():
    import random
    import tracemalloc

    import pyarrow as pa

    r = random.Random(6)
    items = ["=" * 60 + " Results of the run " + "=" * 60, "-" * 90, "ab" * 50, "x = 1; " * 14, "= - " * 30 + "end of it all"]
    index = decontam.Index([(i, t.encode()) for i, t in enumerate(items)], decontam.Q, decontam.RATE)
    assert {i for i, _ in index.repetitive} >= {1, 2, 3}

    def least(p, t):
        prev = np.zeros(len(t) + 1, int)
        for i, a in enumerate(p):
            cur = np.minimum(prev[1:] + 1, prev[:-1] + np.array([a != b for b in t], int))
            cur = np.concatenate([[i + 1], cur])
            prev = np.minimum.accumulate(cur - np.arange(len(cur))) + np.arange(len(cur))
        return int(prev.min())

    seen = Counter()
    for n in range(60):
        s = list(items[n % len(items)])
        for _ in range(r.randint(0, 12)):
            p = r.randrange(len(s))
            s[p : p + r.randint(0, 1)] = r.choice(("", "q", "=", "-"))
        text = "".join(r.choice("ab=-x") for _ in range(r.randint(0, 40))) + "".join(s) + "=" * r.randint(0, 50)
        found = decontam.find(index, *decontam.text_buffer(pa.array([text, "nothing"])))
        want = [(0, i, e) for i, t in enumerate(items) if (e := least(t, text)) <= index.k[i]]
        assert found == want
        seen[bool(want)] += 1
    assert seen[True] > 10

    rulers = [f"{'=' * 40} item {i} of the list, said {i * 7919 % 1000} times over {'=' * 40}" for i in range(50)]
    index = decontam.Index([(i, t.encode()) for i, t in enumerate(rulers)], decontam.Q, decontam.RATE)
    texts = pa.array(["=" * 1_000_000, " " * 1_000_000, rulers[7]])
    tracemalloc.start()
    found = decontam.find(index, *decontam.text_buffer(decontam.folded(texts)))
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert (2, 7, 0) in found and {r for r, _, _ in found} == {2}


def test_op2_makes_pairs_in_pieces(monkeypatch):
    import pyarrow as pa

    words = "one two three four five six seven eight nine ten eleven twelve".split()
    items = [" ".join(words[i:] + words[:i] + [f"tail{i}"]) for i in range(12)]
    index = decontam.Index([(i, t.encode()) for i, t in enumerate(items)], decontam.Q, decontam.RATE)
    buf = decontam.text_buffer(pa.array([items[3] + " and " + items[8], None, items[0]]))
    want = decontam.find(index, *buf)
    monkeypatch.setattr(decontam, "PAIRS", 5)
    assert decontam.find(index, *buf) == want and {(0, 3), (0, 8), (2, 0)} <= {x[:2] for x in want}


def test_op2(spark, sf_dir, rows):
    item = rows[10][1][20:220].strip()
    want = {i for i, t, *_ in rows if t and item in t}
    assert {r["doc_id"] for r in got(spark, sf_dir, "op2_decontaminate") if r["item_id"] == 1} == want


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub(r"\D", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op3_random_texts():
    import random

    r = random.Random(2)
    parts = ["1", "2", "23", "255", ".", ".", "@", "a", "b.c", "+", " ", "-", "(", ")", "4111111111111111", "é", "\n", "%", "٣"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 24)))
        assert [x for x in pii.scan(t) if x[1] < 4] == base_spans(t), t


def test_op3(spark, sf_dir, rows):
    import hashlib

    out = got(spark, sf_dir, "op3_pii")
    assert len(out) == len(rows)
    by = {i: t for i, t, *_ in rows}
    for r in out:
        spans = base_spans(by[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[1] == k for x in spans) for k in range(4)]
    assert "account:" in next(r["spans"] for r in out if r["doc_id"] == 231)


def test_op3_very_long_numbers():
    t = "0" * 6000 + "1.2.3.4 " + "9" * 6000 + ".1.1.1 +1" + "2" * 6000
    assert pii.scan(t) == [(0, 1, 6007)]


def test_redaction():
    t = "a mail@x.example.com b token = 'abcdefgh12345678' c"
    assert pii.redacted(t, pii.scan(t)) == "a [EMAIL] b token = '[SECRET]' c"


def test_secrets_and_accounts_are_validated():
    clean = ["The secret: everything happens", "password: required.", "token: authentication", "Account 2024-2025", "account: 2024-05-31", "Password: Required-Field", "account 123456", "Token = TokenStream"]
    for t in clean:
        assert not [x for x in pii.scan(t) if x[1] >= 4], t
    found = {"API_Key: a8f3k2m9x7": "a8f3k2m9x7", "userToken=9f8e7d6c5b4a3210.": "9f8e7d6c5b4a3210", "PASSWORD = 'hunter2!Xy9'": "hunter2!Xy9", "Account no. 123456": "123456", "ACCOUNT: 00123456": "00123456", "konto 123456789": "123456789", "ſecret\u0130 token: ab12cd34ef": "ab12cd34ef"}
    for t, value in found.items():
        assert [t[a:b] for a, k, b in pii.scan(t) if k >= 4] == [value], t


def test_op4(spark, sf_dir, rows):
    out = {r["doc_id"]: r for r in got(spark, sf_dir, "op4_langid")}
    for i, t, lang, *_ in rows:
        r = out[i]
        assert (r["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))
        assert 0 <= r["score"] <= 1
        if lang and t and len(t) > 80 and i != 231:  # 231 holds addresses and numbers, hardly a word
            assert r["lang_pred"] == lang, i


def test_cross_parsing_against_brute_force():
    import random

    r = random.Random(4)
    sample = {k: "".join(r.choice(a) for _ in range(400)).encode() for k, a in (("x", "abc "), ("y", "bcd "))}
    p = langid.CrossParser(sample)
    for _ in range(50):
        t = "".join(r.choice("abcde ") for _ in range(r.randint(1, 2500))).encode()
        for j, k in enumerate(p.langs):
            n = 0
            for s in range(0, len(t), langid.SEGMENT):
                seg, cur = t[s : s + langid.SEGMENT], b""
                n += 1
                for i in range(len(seg)):
                    c = seg[i : i + 1]
                    if cur + c in sample[k]:
                        cur += c
                    else:
                        n, cur = n + 1, c if c in sample[k] else b""
            assert p.phrases([t])[0][j] == n


def test_op4_with_unequal_samples():
    import random

    from .conftest import WORDS

    r = random.Random(12)
    text = lambda lang, n: " ".join(r.choice(WORDS[lang]) for _ in range(n))
    for small in (1000, 2000, 8000):
        samples = {"de": langid.symbols(text("de", 12000))[: 48 << 10], "en": langid.symbols(text("en", 4000))[:small]}
        texts = [text("en", 40) for _ in range(100)] + [text("de", 40) for _ in range(100)]
        lang = langid.classify(texts, samples)[0]
        assert sum(a == b for a, b in zip(lang, ["en"] * 100 + ["de"] * 100)) >= 196


def test_op4_fit_is_bounded_and_of_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(f"Text number {i} of {i % 7}! " * (i % 40 + 1), ("aa", "bb", "cc")[i % 3]) for i in range(400)] + [(None, "aa"), ("lost", None), ("!!", "dd")], "text string, lang string")
    monkeypatch.setattr(langid, "TOTAL_BYTES", 3000)
    got = langid.fit(docs)
    assert set(got) == {"aa", "bb", "cc"} and all(0 < len(v) <= 750 for v in got.values())
    assert got == langid.fit(docs.repartition(5))
    every = {k: b" ".join(langid.symbols(r["text"]) for r in docs.where(f"lang = '{k}'").collect() if r["text"]) for k in got}
    assert all(set(v.split()[1:-1]) <= set(every[k].split()) for k, v in got.items())


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op5(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ok = [r["vec_id"] is not None and bool(r["embedding"]) and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"]) for r in v]

    def cos(a, b):
        a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
        return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))

    links = [(i, j) for i in range(len(v)) for j in range(i) if ok[i] and ok[j] and len(v[i]["embedding"]) == len(v[j]["embedding"]) and cos(v[i]["embedding"], v[j]["embedding"]) >= 0.9]
    g = groups(len(v), links)
    n = Counter(x for pair in links for x in pair)
    low = {}
    for i, r in enumerate(v):
        low[g[i]] = min(low.get(g[i], 1 << 60), r["vec_id"] if r["vec_id"] is not None else 1 << 60)
    want = sorted(((r["vec_id"] is None, r["vec_id"] or 0), n[i], low[g[i]] if r["vec_id"] is not None else None) for i, r in enumerate(v))
    out = got(spark, sf_dir, "op5_embedding_dedup")
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in out) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_op7(spark, sf_dir, rows):
    bpe = token_counts._encoder(None)
    out = got(spark, sf_dir, "op7_token_count")
    want = sorted(((i is None, i or 0), len(bpe.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"]) for r in out) == want


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_scan_of_flat_files_round_trip(spark, tmp_path, block):
    docs = [[1, 2, 3], [], [4] * 9, [5], []]
    for k, tail in enumerate(([], [8, 8])):
        np.array([x for d in docs for x in [*d, 0]] + tail, "<u2").tofile(tmp_path / f"{k}.bin")
    np.zeros(0, "<u2").tofile(tmp_path / "empty.bin")
    out = token_counts.scan(token_counts.read_flat(spark, str(tmp_path), 2, block), eod=0).collect()
    by = {k: sorted((r["ordinal"], r["n_tokens"], r["closed"]) for r in out if r["file"].endswith(f"{k}.bin")) for k in (0, 1, "empty")}
    full = [(i, len(d), True) for i, d in enumerate(docs)]
    assert by == {0: full, 1: [*full, (5, 2, False)], "empty": []}


def fp(t):
    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_op8(spark, sf_dir, rows):
    f = [fp(t) for _, t, *_ in rows]
    g = groups(len(rows), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[g[i]] = min(low.get(g[i], 1 << 60), r[0])
    want = sorted(((r[0] is None, r[0] or 0), f"{f[i]:016x}", low.get(g[i])) for i, r in enumerate(rows))
    out = got(spark, sf_dir, "op8_simhash_dedup")
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in out) == want


@pytest.mark.parametrize("bits", [2, 3, 4, 5])
def test_deletion_variants_meet_every_link(spark, bits):
    import random

    r = random.Random(bits)
    a = [r.getrandbits(64) for _ in range(60)]
    pairs = []
    for x in a:
        y = x
        for b in r.sample(range(64), bits):
            y ^= 1 << b
        pairs.append((x, y))
    far = [x ^ sum(1 << b for b in r.sample(range(64), bits + 1)) for x in a[:20]]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(sign(x),) for p in pairs for x in p] + [(sign(x),) for x in far], "fp bigint").distinct()
    found = [(u, v) for u, v in simhash.links(nodes, bits).collect()]
    values = sorted({x for e in found for x in e} | {sign(x) for p in pairs for x in p})
    at = {x: i for i, x in enumerate(values)}
    g = groups(len(values), [(at[u], at[v]) for u, v in found])
    assert all(g[at[sign(x)]] == g[at[sign(y)]] for x, y in pairs)
    mask = (1 << 64) - 1
    assert all(((u & mask) ^ (v & mask)).bit_count() <= 3 * bits for u, v in found)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = c.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = [dict(zip(names, r)) for r in want.fetchall()]
    out = got(spark, sf_dir, name)
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for _, v in sorted(r.items()))
    assert sorted(map(key, out)) == sorted(map(key, want))


def test_op9_near_targets(spark, sf_dir):
    out = got(spark, sf_dir, "op9_mix")
    assert all(r["taken"] in {k * r["size"] for k in range(4)} for r in out)
    assert math.isclose(sum({(r["source_size"], r["target"]) for r in out} and [t for _, t in {(r["source_size"], r["target"]) for r in out}]), sum(r["size"] for r in out), rel_tol=1e-9)


def test_op9_meets_targets_with_null_and_repeated_rows(spark):
    import random

    from ranksmith.llm import mixing

    r = random.Random(8)
    text = lambda: " ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 60)))
    rows = [(None, text(), "a", 1, 7) for _ in range(900)] + [(None, "one and the same text", "b", 2, 7)] * 1500
    rows += [(5, text(), None, 3, 7) for _ in range(600)] + [(i, text(), "c", 4, 7) for i in range(700)] + [(9, None, "c", 5, 7)] * 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int, SIZE int").repartition(7)
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == ["doc_id", "text", "source", "n", "SIZE_input", "size", "source_size", "target", "copies"]
    out = [x.asDict() for x in mixed.collect()]
    assert len(out) == len(rows) and {x["SIZE_input"] for x in out} == {7}
    taken, target = Counter(), {}
    for x in out:
        taken[x["source"]] += x["size"] * x["copies"]
        target[x["source"]] = x["target"]
        assert 0 <= x["copies"] <= 3
    assert sorted(target, key=lambda s: (s is None, s)) == ["a", "b", "c", None]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target), (taken, target)
    again = [x.asDict() for x in mixing.mix_rows(docs.repartition(3)).collect()]
    digest = lambda rows: sorted((str(x["doc_id"]), str(x["text"]), str(x["source"]), x["copies"]) for x in rows)
    assert digest(again) == digest(out)


def test_op6_pairs_share_all_but_the_last_reply(spark, sf_dir):
    out = {r["pair_id"]: r for r in got(spark, sf_dir, "op6_preference_format")}
    for i in range(8):
        assert out[i]["n_prompt"] >= 3 and out[i]["prompt"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")
    assert out[8]["n_chosen"] == 0 == out[8]["n_rejected"] and out[8]["n_prompt"] == 2
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}/{t}") for c in range(50) for t in range(2 + 2 * (c % 3))]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    from ranksmith.llm import preferences

    for bucket in (4, 4096):
        pairs = preferences.formatted(preferences.reply_pairs(conv, bucket)).collect()
        assert len(pairs) == 50
        dealt = Counter()
        for p in pairs:
            turns = 2 + 2 * (p["pair_id"] % 3)
            alone = p["rejected"] == ""
            assert p["n_prompt"] == turns - (not alone)
            if not alone:
                assert p["chosen"] == f"<|im_start|>assistant\n{p['pair_id']}/{turns - 1}<|im_end|>\n" != p["rejected"]
                a, b = map(int, p["rejected_mask"].split(":"))
                assert p["rejected"][a:b].endswith("<|im_end|>")
                dealt[p["rejected"]] += 1
        assert max(dealt.values()) == 1 and len(dealt) >= 40


def test_op10(spark, sf_dir):
    out = got(spark, sf_dir, "op10_html_extract")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out) == [
        (1, "T & U\n\nFirst paragraph bold.\n\nGo.", 34 - 1),
        (1, "plain text only", 15),
        (2, "", 0),
        (3, "", 0),
    ]


def test_op10_furniture():
    html = """<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
    <div id="content"><div class="post"><h1>Title</h1><p>A long paragraph with a good number of characters in it.
    <p>Short.<p>Another long paragraph &lt;with&gt; enough characters &amp; more.</div>
    <div class="comments"><p>a reader's comment that is rather long and should not be kept at all</p></div></div>
    <aside>side</aside><form><label>Name</label></form><footer>foot</footer><script>if (a < b) x("<p>");</script></body>"""
    assert html_extract.extract(html) == "Title\n\nA long paragraph with a good number of characters in it.\n\nShort.\n\nAnother long paragraph <with> enough characters & more."


def test_hot_keys_are_cut_in_tiles(spark):
    import random

    r = random.Random(5)
    rows, base = [], [r.getrandbits(64) for _ in range(3)]
    for i in range(90):  # one key with two thirds of the rows
        fp = base[i % 3]
        for b in r.sample(range(64), r.randint(0, 4)):
            fp ^= 1 << b
        rows.append((0 if i % 3 else i % 7 + 1, fp - (1 << 64) if fp >> 63 else fp))
    rows = list(dict.fromkeys(rows))
    keyed = spark.createDataFrame(rows, "key bigint, node bigint")
    nodes = sorted({n for _, n in rows})
    at = {n: i for i, n in enumerate(nodes)}
    near = [(at[a], at[b]) for k, a in rows for k2, b in rows if k == k2 and a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    want = groups(len(nodes), near)
    for tile in (1, 7, 1000):
        found = [(at[u], at[v]) for u, v in simhash.meetings(keyed, 4, "t", tile).collect()]
        assert set(found) <= {(u, v) for u in range(len(nodes)) for v in range(len(nodes)) if want[u] == want[v]}
        assert groups(len(nodes), found) == want


def test_hot_classes_are_joined_whole(spark):
    from ranksmith.llm.common import classed

    rows = spark.createDataFrame([(i, i % 3000 if i % 2 else 0) for i in range(6000)], "id bigint, k bigint")
    classes = rows.groupBy("k").count().selectExpr("k", "count n", "k * 2 c")
    out = classed(rows, classes, "k", "t").collect()
    assert sorted((r["id"], r["k"], r["c"]) for r in out) == [(i, i % 3000 if i % 2 else 0, 2 * (i % 3000 if i % 2 else 0)) for i in range(6000)]


def test_representatives_of_rows_that_share_an_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "north south east west up down left")
    docs = spark.createDataFrame([(None, a), (None, b), (1, c), (1, a), (2, a), (2, c), (2, c), (None, b)], "doc_id bigint, text string")
    docs = docs.selectExpr("*", "1 AS _id", "2 AS _digest", "3 AS _n", "4 AS row", "5 AS place", "6 AS id", "7 AS digest", "8 AS h")
    assert simhash.keep_representatives(docs).columns == docs.columns
    out = simhash.keep_representatives(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in out) == [(False, 1, a), (False, 1, c), (True, None, b)]


@pytest.mark.parametrize("least", [2, 256])
def test_components_with_hubs(spark, monkeypatch, least):
    from ranksmith.llm import common

    monkeypatch.setattr(common, "LEAST_HUB", least)
    monkeypatch.setattr(common, "HOT", 4)
    r = np.random.default_rng(5)
    edges = [(5000, i) for i in range(1000, 2200)]  # the hub has the greatest number
    edges += [(3, i) for i in range(4000, 4800)] + [(4799, 6000), (6000, 6001)]  # and the smallest
    edges += [(i, i + 1) for i in range(7000, 7060)] + [tuple(map(int, e)) for e in r.integers(8000, 8400, (150, 2))]
    edges += [(9, 9), (3, 4000), (4000, 3)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    g = groups(len(nodes), [(at[u], at[v]) for u, v in edges if u != v])
    least_of = {}
    for x, k in zip(nodes, g):
        least_of[k] = min(x, least_of.get(k, x))
    out = common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted(map(tuple, out)) == [(x, least_of[k]) for x, k in zip(nodes, g)]


@pytest.mark.parametrize(("edges_a_task", "held"), [(1 << 18, 1 << 20), (1 << 18, 7), (4, 7)])
def test_components_in_one_task_or_rounds(spark, monkeypatch, edges_a_task, held):
    from ranksmith.llm import common

    monkeypatch.setattr(common, "EDGES", edges_a_task)
    monkeypatch.setattr(common, "_HELD", held)
    monkeypatch.setattr(common, "LEAST_HUB", 2)
    monkeypatch.setattr(common, "HOT", 4)
    r = np.random.default_rng(7)
    edges = [(-5, i) for i in range(100, 160)] + [(i + 1, i) for i in range(300, 330)] + [(8, 8), (100, -5), (100, -5)]
    edges += [tuple(map(int, e)) for e in r.integers(-900, -800, (60, 2))] + [(None, 4), (4, None)]
    real = [e for e in edges if None not in e and e[0] != e[1]]
    nodes = sorted({x for e in real for x in e})
    g = groups(len(nodes), [(nodes.index(u), nodes.index(v)) for u, v in real])
    least_of = {}
    for x, k in zip(nodes, g):
        least_of[k] = min(x, least_of.get(k, x))
    out = common.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect()
    assert sorted(map(tuple, out)) == [(x, least_of[k]) for x, k in zip(nodes, g)]


def test_components_of_few_edges_take_few_jobs(spark):
    from ranksmith.llm import common

    sc = spark.sparkContext
    sc.setJobGroup("components", "the jobs of a path of 200 nodes")
    out = common.components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u bigint, v bigint"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("components")) <= 6
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(201)]


def near_groups(texts):
    """Components of texts by the exact similarity of their five-word shingles."""

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    s = [shingles(t) for t in texts]
    return groups(len(texts), [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8])


def same_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = near_groups(texts)
    low = {}
    for i, g in enumerate(want):
        low[g] = min(i, low.get(g, i))
    assert sorted(map(tuple, simhash.near_copies(docs).collect())) == [(i, low[g]) for i, g in enumerate(want)]
    return want


def test_near_copies_by_exact_similarity(spark):
    texts = []
    for k in range(40):  # 100 shingles, of which a change in the middle takes five on each side
        w = [f"w{k}x{i}" for i in range(104)]
        texts.append(" ".join(w))
        if k % 2:  # 90 of 110: 0.82
            texts.append(" ".join(w[:30] + ["x"] + w[31:70] + ["y"] + w[71:]))
        else:  # 86 of 114: 0.75
            texts.append(" ".join(w[:30] + ["x"] + w[31:70] + ["y"] + w[71:100] + ["z"] + w[101:]))
    g = same_groups(spark, texts)
    assert len(set(g)) == 60


def test_near_copies_by_fingerprints_alone(spark, monkeypatch):
    """The operator's own method gives links to the near copies: without any prefix key."""
    docs, same = [], []
    for k in range(30):
        w = [f"w{k}x{i}" for i in range(400)]
        v = w[:200] + ["x"] + w[201:]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        a, b = (simhash.fingerprint(t.encode()) for _, t in docs[-2:])
        same.append(bin(a ^ b).count("1") <= simhash.BITS)
    assert 5 < sum(same)
    none = "u bigint, v bigint, n bigint, m bigint"
    monkeypatch.setattr(simhash, "_cold_pairs", lambda keyed, hot, similarity: spark.createDataFrame([], none))
    out = dict(map(tuple, simhash.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()))
    assert [out[2 * k + 1] == 2 * k for k in range(30)] == same


def test_sketches_against_counts():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 70_000, 3, 131_080)]
    for s, got in zip(sets, simhash.sketches(sets)):
        for lane in range(simhash.LANES):
            x = simhash.mix64(s + np.uint64(int(simhash._ODD) * (lane + 1) % (1 << 64)))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            assert int(got[lane]) == sum(1 << i for i in range(64) if bits[i] * 2 > len(s))


def test_near_copies_of_hot_keys(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "GROUP", 3)
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "LEADERS", 1)
    monkeypatch.setattr(simhash, "AFEW", 0.2)
    monkeypatch.setattr(simhash, "TURNS", 2)
    r = random.Random(11)
    texts = []
    for k in range(3):  # chains of edits: neighbours are similar, the ends are not
        w = [f"w{k}x{i}" for i in range(r.randint(40, 70))]
        for i in range(40):
            v = list(w)
            v[r.randrange(len(v))] = f"y{k}x{i}"
            texts.append(" ".join(v))
            if r.random() < 0.4:
                w = v
    g = same_groups(spark, texts)
    assert 6 < len(set(g)) < 110 and max(Counter(g).values()) > 12


def test_near_copies_of_short_texts(spark):
    import random

    r = random.Random(9)
    texts = []
    for size, more in ((25, 2), (30, 4), (40, 5), (60, 0)):
        for _ in range(25):
            w = [f"w{r.getrandbits(40)}" for _ in range(size)]
            v = w + [f"w{r.getrandbits(40)}" for _ in range(more)]
            if not more:
                v[size // 2] = "x"
            texts += [" ".join(w), " ".join(v)]
    g = same_groups(spark, texts)
    assert len(set(g)) == len(texts) // 2


def test_op2_folds_case_and_white_space(spark):
    item = "Die größte Überraschung: später führte der schöne Weg über die Brücke, wo die Mädchen müde fröhliche Lieder für die Gäste übten und Äpfel schälten."
    texts = [item.upper(), item.replace(" ", "\n\t  "), item.replace(" ", " \u00a0 ").upper(), "nothing of it"]
    docs = spark.createDataFrame([(i, "Vorher. " + t + " Nachher.") for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, " " + item.upper() + "\n")], "item_id bigint, text string")
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == [(d, i, 0) for d in range(3) for i in (1, 2)]
    assert [tuple(r) for r in decontam.drop_contaminated(docs, items).collect()] == [(3, "Vorher. nothing of it Nachher.")]


def _page(r):
    """A random page and its text: content in an article or a main, with furniture in and around."""
    import html as escapes

    want = []
    words = lambda a, b: " ".join(r.choice(("alpha", "b&eta", "<gamma>", "délta", "eps'", "zeta")) for _ in range(r.randint(a, b)))
    spaced = lambda t: escapes.escape(t).replace(" ", r.choice((" ", "  ", "\n\t ", "&nbsp;")))

    def inline(t):
        cut = r.randint(0, len(t))
        a, b = escapes.escape(t[:cut]), escapes.escape(t[cut:])
        return r.choice((f"{a}<b>{b}</b>", f"<i><b>{a}</i>{b}", f"<a href='/x?a=1&b=<2'>{a}</a>{b}", f"<span class=ad-hoc>{a}</span>{b}"))

    def furniture():
        return r.choice(("<nav><ul><li>{0}<li>{0}</ul></nav>", "<div class='ad'>{0}</div>", "<aside><p>{0}</p></aside>", "<script>if (a<b) '{0}'</script>", "<form><p>{0}</p></form>", "<div id=comments><p>{0}</p></div>", "<ul class='share-buttons'><li>{0}</ul>", "<!-- {0} -->", "<div style='display: none'>{0}</div>", "<div role=dialog>{0}</div>", "<section class='cookie-notice box'><p>{0}</p></section>")).format(escapes.escape(words(1, 12)))

    def block(depth):
        k = r.random()
        if k < 0.2:
            return furniture()
        if k < 0.4 and depth < 4:
            tag = r.choice(("div", "section", "blockquote", "div class='alert-text'", "section class='story share'", "div class=post"))
            return f"<{tag}>{''.join(block(depth + 1) for _ in range(r.randint(1, 3)))}</{tag.split()[0]}>"
        t = words(1, 25)
        want.append(" ".join(t.split()))
        tag = r.choice(("p", "p class=related", "h2 id=share", "pre", "p class='ad-hoc notice'"))
        return f"<{tag}>{r.choice((inline, spaced))(t)}</{tag.split()[0]}>"

    body = "".join(block(0) for _ in range(r.randint(1, 6)))
    tag = r.choice(("article", "main", "article class=share"))
    around = lambda: "".join(furniture() for _ in range(r.randint(0, 3)))
    inner = f"<{tag}>{body}</{tag.split()[0]}>"
    return f"<html><head><title>x</title></head><body><header><h1>{words(1, 3).replace('<', '')}</h1></header>{around()}<div class=wrapper>{inner}</div>{around()}<footer>foot</footer></body></html>", "\n\n".join(want)


def test_op10_random_pages():
    import random

    r = random.Random(14)
    for _ in range(400):
        page, want = _page(r)
        have = html_extract.extract(page).replace("\u00a0", " ")
        assert have == want, page


def test_op10_of_pages_without_content_and_of_hostile_ones():
    import time

    assert html_extract.extract("<div>Home</div><div>About</div><div>Login</div><div>Copyright 2020</div>") == ""
    text = "A sentence that says something at length. " * 4
    page = f"<body><ul><li>Home<li>About<li>Login</ul><h1>Title</h1><p>{text}<p>Go.<p>{text}<div>Copyright 2020</div>"
    assert html_extract.extract(page) == f"Title\n\n{text.strip()}\n\nGo.\n\n{text.strip()}"
    for part in ("<div>a", "<font>a<div>b</div>", "<ul><li>x", "<p>x<b>y", "<!--", "<a ", "<a href='", "</p>", "<b><i></b>", "<!x", "<script></x"):
        times = []
        for n in (20_000, 80_000):
            t = time.process_time()
            html_extract.extract(part * (n // len(part)))
            times.append(time.process_time() - t)
        assert times[1] < 0.05 + 8 * times[0], part


def test_op10_without_article():
    long = "A very long block that holds nearly all of the text of the page. " * 40
    html = f"<body><nav>menu</nav><div id='all'><h1>The title of it</h1><div class='text'>{long}</div><blockquote>A short quotation of some words, said by one.</blockquote></div></body>"
    assert html_extract.extract(html) == f"The title of it\n\n{long.strip()}\n\nA short quotation of some words, said by one."
    html = f"<body><div><p>First short paragraph of the page.</p><em>{long}</em><p>Last short paragraph of the page.</p></div></body>"
    assert html_extract.extract(html) == f"First short paragraph of the page.\n\n{long.strip()}\n\nLast short paragraph of the page."


def test_op10_keeps_short_articles():
    long = "A very long block that holds nearly all of the text of the page. " * 40
    out = html_extract.extract(f"<body><article><p>Tiny.</p></article>{'<p><b>x</b></p>' * 12}<article><p>{long}</p></article></body>")
    assert out == f"Tiny.\n\n{long.strip()}"
