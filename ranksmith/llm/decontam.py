"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document is contaminated by a benchmark item of m bytes if some region of it is within an
edit distance of k = floor(RATE * m) of the item. In both, case is folded as Unicode does and
runs of white space are one space; m and distances are over the UTF-8 bytes of that.

An occurrence within k edits keeps at least m - q + 1 - k q of the item's q-grams, on
diagonals (document place minus item place) that lie at most k apart. So shared q-grams are
counted in overlapping bands of 2 (k + 1) diagonals, one every k + 1; bands with enough hits
are regions, and every region is verified by an alignment confined to its band. The filter
loses nothing: where the bound is not positive, k is lowered until it is; items shorter than q
are searched for exactly. RATE and Q fix the bound; no count is capped.

A q-gram that an item holds over HEAVY times (rulers, repeated signs) would make pairs of places
by the square. It is not counted in bands: an occurrence keeps at least as many of the other
q-grams as the bound less the item's heavy places. An item for which that leaves nothing is
filtered by windows instead: an occurrence lies within m + k bytes, of which at least the bound's
number begin a q-gram of the item, and all bands of such windows are regions. Pairs are made at
most PAIRS at a time and regions aligned at most CELLS cells at a time. Before alignment a region
is counted by byte values: one that lacks over k of the item's bytes can't hold it.

The benchmark is the query set and is read in blocks of at most BLOCK_BYTES, each sent with a
pass over the documents; documents are neither shuffled nor collected. Null and empty
documents and items match nothing. Repeated rows are each reported. Empty tables give empty
results (documents all stay). Extra columns are ignored by matches, kept by drop_contaminated.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, table, text_buffer, tidy

Q, RATE = 8, 0.1
BLOCK_BYTES = 4 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x09:0x0E] = 32
_BITS = 21
_MUL = np.uint64(0x9E3779B97F4A7C15)
HEAVY, PAIRS, CELLS = 4, 1 << 21, 1 << 21


def fold(text: str) -> str:
    return " ".join(text.casefold().split())


def folded(col: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fold(t) for t in col.to_pylist()], pa.large_string())


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item of m bytes: the most, up to rate * m, that the lemma can bound."""
    return max(0, min(int(rate * m), (m - q) // q))


class Index:
    """q-grams of one block of items: sorted keys, with the (item, place) pairs of each."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, rate: float):
        self.q, self.ids = q, [i for i, _ in items]
        self.text = [_FOLD[np.frombuffer(t, np.uint8)] for _, t in items]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.k = np.array([budget(m, q, rate) for m in self.size], np.int64)
        self.need = self.size - q + 1 - self.k * q
        self.short = [i for i, m in enumerate(self.size) if 0 < m < q]
        self.repetitive: list[tuple[int, np.ndarray]] = []  # items found by windows, their q-grams
        keys, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, t in enumerate(self.text):
            g = grams(t, q)
            if not len(g):
                continue
            own, back, times = np.unique(g, return_inverse=True, return_counts=True)
            at = np.flatnonzero(times[back] <= HEAVY)
            self.need[i] -= len(g) - len(at)
            if self.need[i] < 1:
                self.need[i] += len(g) - len(at)
                self.repetitive.append((i, own))
                continue
            keys.append(g[at])
            item.append(np.full(len(at), i, np.int32))
            place.append(at.astype(np.int32))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.item, self.place = np.concatenate(item)[order], np.concatenate(place)[order]
        self.keys, self.first, self.times = np.unique(key[order], return_index=True, return_counts=True)
        self.mark = np.zeros(1 << _BITS, bool)
        self.mark[self.slot(self.keys)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MUL) >> np.uint64(64 - _BITS)


def grams(buf: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (q up to 8) at every place as one number."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    w = np.ndarray((n,), "<u8", pad, 0, (1,)).copy()
    return w & np.uint64((1 << 8 * q) - 1) if q < 8 else w


def _aligned(index: Index, buf: np.ndarray, item: np.ndarray, low: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least edits of each region: item against the document bytes [lo, hi), on the diagonals
    from low on that the item's band allows. Rows of all regions advance together."""
    m, width = index.size[item], int((3 * (index.k[item] + 1)).max()) + 1
    far = np.int32(1 << 20)
    j = np.arange(width, dtype=np.int32)
    d = np.zeros((len(item), width), np.int32)  # an occurrence may start on any diagonal
    out = np.full(len(item), far)
    pattern = np.zeros((len(item), int(m.max())), np.uint8)
    for r, i in enumerate(item):
        pattern[r, : m[r]] = index.text[i]
    for i in range(int(m.max())):
        at = low[:, None] + i + j
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        c = buf[np.where(inside, at, 0)]
        step = d + ((c != pattern[:, i : i + 1]) | ~inside)
        step[:, :-1] = np.minimum(step[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(step - j, axis=1) + j
        ends = m == i + 1
        if ends.any():
            out[ends] = d[ends].min(1)
    return out


def _bands(index: Index, at: np.ndarray, k: np.ndarray, row: np.ndarray, span: int, shift: int) -> np.ndarray:
    """Keys (row, item, band) with enough hits: document places at, their q-grams k."""
    times = index.times[k]
    upto = np.cumsum(times)
    found, counts, a = [], [], 0
    while a < len(k):  # pieces of about PAIRS pairs
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - times[a] + PAIRS, "right")))
        t = times[a:b]
        pick = np.repeat(index.first[k[a:b]] - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
        item = index.item[pick].astype(np.int64)
        band = (np.repeat(at[a:b], t) - index.place[pick] + shift) // (index.k[item] + 1)
        # A hit is in its own band and in the one before it. Rows are apart: a band can reach
        # over a row's edge, its hits can't.
        key = (np.repeat(row[a:b], t) * len(index.ids) + item) * span + band
        u, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        found.append(u)
        counts.append(n)
        a = b
    if not found:
        return np.zeros(0, np.int64)
    uniq, back = np.unique(np.concatenate(found), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts))
    return uniq[n >= index.need[uniq // span % len(index.ids)]]


def _windows(index: Index, i: int, own: np.ndarray, g: np.ndarray, off: np.ndarray, span: int, shift: int) -> np.ndarray:
    """Keys (row, item i, band) of all bands of windows of a row with enough q-grams of the item."""
    at = np.searchsorted(own, g)
    at[at == len(own)] = 0
    at = np.flatnonzero(own[at] == g)
    row = np.searchsorted(off, at, "right") - 1
    whole = at + index.q <= off[row + 1]
    at, row = at[whole], row[whole]
    need, reach, step = int(index.need[i]), int(index.size[i] + index.k[i]), int(index.k[i]) + 1
    if len(at) < need:
        return np.zeros(0, np.int64)
    last = np.arange(need - 1, len(at))  # the window that ends with this place and holds `need`
    good = last[(at[last] - at[last - need + 1] <= reach) & (row[last] == row[last - need + 1])]
    keys = [np.zeros(0, np.int64)]
    # The item's start is at most `reach` before the last place and not after the first one.
    lo, hi = (at[good] - reach + shift) // step - 1, (at[good - need + 1] + shift) // step + 1
    key = (row[good] * len(index.ids) + i) * span
    lo, hi = key + np.maximum(lo, 0), key + hi
    top = np.maximum.accumulate(hi) if len(hi) else hi
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1] + 1])) if len(lo) else np.zeros(0, np.int64)
    for a, b in zip(new, np.append(new[1:], len(lo))):
        keys.append(np.arange(lo[a], top[b - 1] + 1))
    return np.unique(np.concatenate(keys))


_BLOCK = 64


def _bytes_upto(raw: np.ndarray) -> np.ndarray:
    """How many bytes of each value there are before each block."""
    n = -(-len(raw) // _BLOCK)
    upto = np.zeros((n + 1, 256), np.int32)
    for a in range(0, n, 4096):
        part = raw[a * _BLOCK : (a + 4096) * _BLOCK]
        m = -(-len(part) // _BLOCK)
        upto[a + 1 : a + m + 1] = np.bincount((np.arange(len(part)) // _BLOCK << 8) + part, minlength=m << 8).reshape(m, 256)
    return np.cumsum(upto, axis=0, out=upto)


def _complete(index: Index, upto: np.ndarray, off: np.ndarray, uniq: np.ndarray, span: int, shift: int) -> np.ndarray:
    """Those of the region keys whose bytes, by number of each value, lack at most k of the item's.
    Bytes are counted by blocks, a region's rounded outwards."""
    if not len(uniq):
        return uniq
    item, row, band = uniq // span % len(index.ids), uniq // span // len(index.ids), uniq % span
    keep = np.zeros(len(uniq), bool)
    order = np.argsort(item, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        i = item[group[0]]
        value, least = np.unique(index.text[i], return_counts=True)
        for a in range(0, len(group), 1 << 14):
            o = group[a : a + (1 << 14)]
            low = band[o] * (index.k[i] + 1) - shift - index.k[i] // 2
            lo = np.clip(low, off[row[o]], off[row[o] + 1])
            hi = np.clip(low + 4 * (index.k[i] + 1) + index.size[i], off[row[o]], off[row[o] + 1])
            has = upto[np.ix_(-(-hi // _BLOCK), value)] - upto[np.ix_(lo // _BLOCK, value)]
            keep[o] = np.maximum(least - has, 0).sum(1) <= index.k[i]
    return uniq[keep]


def find(index: Index, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, item, least edits) of every contaminated row and item."""
    best: dict[tuple[int, int], int] = {}
    shift = int(index.size.max(initial=0))
    for a, b in chunks(offsets, 2 << 20):
        off = offsets[a : b + 1] - offsets[a]
        raw = _FOLD[buf[offsets[a] : offsets[b]]]
        for i in index.short:
            needle = index.text[i].tobytes()
            for row in range(a, b):
                if needle in raw[off[row - a] : off[row - a + 1]].tobytes():
                    best[row, i] = 0
        g = grams(raw, index.q)
        if not len(g):
            continue
        span = len(raw) + 2 * shift + 2
        uniq = [np.zeros(0, np.int64)]
        if len(index.keys):
            at = np.flatnonzero(index.mark[index.slot(g)])
            k = np.searchsorted(index.keys, g[at])
            k[k == len(index.keys)] = 0
            hit = index.keys[k] == g[at]
            at, k = at[hit], k[hit]
            row = np.searchsorted(off, at, "right") - 1
            whole = at + index.q <= off[row + 1]
            uniq.append(_bands(index, at[whole], k[whole], row[whole], span, shift))
        upto = _bytes_upto(raw)
        uniq = [_complete(index, upto, off, u, span, shift) for u in uniq]
        uniq += [_complete(index, upto, off, _windows(index, i, own, g, off, span, shift), span, shift) for i, own in index.repetitive]
        uniq = np.concatenate(uniq)
        item, row, band = uniq // span % len(index.ids), uniq // span // len(index.ids), uniq % span
        order = np.lexsort((row, index.size[item]))  # like sizes are aligned together
        s = 0
        while s < len(order):
            o = order[s : s + max(1, CELLS // int(3 * index.k[item[order[s : s + 256]]].max() + 4))][:256]
            s += len(o)
            o = o[[best.get((r, i), 1) > 0 for r, i in zip((row[o] + a).tolist(), item[o].tolist())]]
            if not len(o):
                continue
            it = item[o]
            low = band[o] * (index.k[it] + 1) - shift - index.k[it] // 2
            edits = _aligned(index, raw, it, low, off[row[o]], off[row[o] + 1])
            for r, i, e in zip(row[o] + a, it, edits):
                if e <= index.k[i]:
                    key2 = (int(r), int(i))
                    best[key2] = min(best.get(key2, int(e)), int(e))
    return [(r, i, e) for (r, i), e in sorted(best.items())]


def _index(items: list[tuple[int, bytes]], q: int, rate: float) -> Index:
    kept = sys.__dict__.setdefault("_ranksmith_qgrams", {})
    key = (hash(tuple(items)), q, rate)
    if key not in kept:
        kept.clear()
        kept[key] = Index(items, q, rate)
    return kept[key]


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES):
    """The benchmark's (item_id, text) in blocks of bounded size."""
    block, n = [], 0
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        t = fold(r["text"]).encode()
        if block and n + len(t) > size:
            yield block
            block, n = [], 0
        block.append((r["item_id"], t))
        n += len(t)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits) of every document and item within the item's budget."""
    schema = "doc_id bigint, item_id bigint, edits bigint"
    src = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")

    def one(block):
        def run(batches):
            index = _index(block, q, rate)
            for b in batches:
                found = find(index, *text_buffer(folded(b.column(1))))
                tidy()
                rows = pa.array([r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([int(index.ids[i]) for _, i, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.int64())], names=["doc_id", "item_id", "edits"])

        return src.mapInArrow(run, schema)

    parts = [one(b) for b in blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """docs without the contaminated rows."""

    def one(df, block):
        def run(batches):
            index = _index(block, q, rate)
            for b in batches:
                bad = {r for r, _, _ in find(index, *text_buffer(folded(b.column(b.schema.get_field_index("text")))))}
                tidy()
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        return df.mapInArrow(run, docs.schema)

    return reduce(one, blocks(benchmark), docs)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
