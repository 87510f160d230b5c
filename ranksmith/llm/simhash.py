"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits; bit i is set if it is set in over half of the 64-bit hashes (XXH64,
seed 42) of the text's shingles, repeats counted. Fingerprints that differ in at most `bits`
bits are linked, and links make components.

Candidates: a fingerprint is cut in bits // 2 + 1 segments, so that of two linked ones at
least one segment differs by at most one bit. Each segment is indexed under all its variants
with one bit taken out (64 keys a fingerprint, whatever the number of segments), so the two
meet under an equal key. An equality shuffle on keys brings them together and every meeting is
verified on the whole fingerprints. Equal fingerprints are one node from the start; a task
compares the fingerprints under a key block by block and emits a spanning forest of the links
found, at most one row a fingerprint, never the pairs of a group.

A null or empty text has fingerprint zero, linked like any other; a text with fewer words than
a shingle has its whole sequence as its one shingle. Repeated rows get a row each. A null
doc_id takes part in its component but is not the smallest id unless all its ids are null.
An empty table gives an empty result. Extra columns are ignored by dedup and kept by
keep_representatives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _MADE, _delete, classed, components, local_roots, materialize, mix64, n_partitions, named_roots, release, table, text_buffer, tidy, word_hashes

SHINGLE, BITS, SEED = 4, 4, 42
#: Shingle hashes turned into bit counts at a time.
_PIECE = 1 << 16
#: Rows compared as one group; hot keys up to which they are broadcast; rows of a block and of
#: the stream buffered for one round of comparisons.
TILE, BROADCAST_KEYS, _ROWS, _BUFFER = 8192, 100_000, 256, 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(hashes[i : i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            text = b.column(1).cast(pa.binary() if pa.types.is_string(b.column(1).type) else pa.large_binary())
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in text), np.uint64, b.num_rows)
            tidy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the bits // 2 + 1 segments."""
    n = bits // 2 + 1
    cut = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def variant_keys(bits: int):
    """Columns of the 64 keys of `fp`: the segment with one bit taken out, and which bit."""
    keys = []
    for at, width in segments(bits):
        seg = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        for i in range(width):
            low = seg.bitwiseAND(F.lit((1 << i) - 1))
            high = F.shiftleft(F.shiftrightunsigned(seg, i + 1), i)
            keys.append(F.shiftleft(low.bitwiseOR(high), 6).bitwiseOR(F.lit(at + i).cast("long")))
    return keys


def _close(key: np.ndarray, node: np.ndarray, lanes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows under equal keys (sorted by key), as a spanning forest."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    stop = np.append(run[1:], len(key))
    size = np.repeat(stop - run, stop - run)
    end = np.repeat(stop, stop - run)
    rows = np.flatnonzero(size > 1)
    d = 1
    while True:
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        near = _differ(lanes, rows, rows + d) <= most
        if near.any():
            found.append((node[rows[near]], node[rows[near] + d]))
            held += int(near.sum())
            if held > 1 << 20:
                nodes, root = local_roots(*(np.concatenate(x) for x in zip(*found)))
                found, held = [(nodes, root)], len(nodes)
        d += 1
    return _forest(found)


def _across(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the (node, lanes) of tile a and those of tile b, as a spanning forest."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(a[0]), _ROWS):
        differ = np.zeros((len(a[0][i : i + _ROWS]), len(b[0])), np.int16)
        for lane in range(a[1].shape[1]):
            differ += np.bitwise_count(a[1][i : i + _ROWS, lane, None] ^ b[1][None, :, lane])
        r, c = np.nonzero(differ <= most)
        if len(r):
            found.append(local_roots(a[0][i + r], b[0][c]))
    return _forest(found)


def _differ(lanes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n = np.zeros(len(i), np.int16)
    for lane in range(lanes.shape[1]):
        n += np.bitwise_count(lanes[i, lane] ^ lanes[j, lane])
    return n


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, root = local_roots(*(np.concatenate(x) for x in zip(*found)))
    return nodes[nodes != root], root[nodes != root]


def _columns(t: pa.RecordBatch | pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns as arrays; `lanes`, where there is none, is the node's own 64 bits."""
    out = []
    for name in names:
        if name != "lanes":
            out.append(t[name].to_numpy() if isinstance(t, pa.Table) else t[name].to_numpy(zero_copy_only=False))
        elif name in t.schema.names:
            out.append(np.frombuffer(b"".join(t[name].to_pylist()), np.uint64).reshape(t.num_rows, -1))
        else:
            out.append(out[names.index("node")].view(np.uint64)[:, None])
    return out


def meetings(keyed: DataFrame, most: int, name: str, tile: int | None = None) -> DataFrame:
    """(u, v): the links among rows of keyed (key, node, lanes) that share a key and differ in
    at most `most` bits, thinned to forests.

    Keys are counted first. Rows whose key has up to `tile` of them meet in a shuffle by key,
    sorted there by Spark, and are compared group by group as they stream by. A key with more
    rows is cut in tiles of about that size by the hash of the node, and each pair of its tiles
    is a group of its own. So no task holds more than two tiles, whatever a key's share of all
    rows, and no pair is left out.
    """
    spark = keyed.sparkSession
    tile = tile or TILE
    has = [c for c in ("key", "node", "lanes") if c in keyed.columns]
    cut = F.ceil(F.col("n") / tile).cast("int")
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select(F.col("key").alias("_key"), cut.alias("_tiles"))
    many = materialize(many, f"{name}-hot")
    n = many.count()
    hint = F.broadcast(many) if n <= BROADCAST_KEYS else many

    def cold(batches):
        held, n, found = [], 0, []
        for b in batches:
            held.append([x.copy() for x in _columns(b, ("key", "node", "lanes"))])
            n += b.num_rows
            if n < _BUFFER:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            at = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key can go on
            found.append(_close(*(x[:at] for x in rows), most))
            held, n = [[x[at:].copy() for x in rows]], n - at
            if sum(len(u) for u, _ in found) > 1 << 20:
                u, v = _forest(found)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        if n:
            found.append(_close(*(np.concatenate(x) for x in zip(*held)), most))
        u, v = _forest(found)
        del held, found
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    rest = keyed.select(*has)
    if n:
        rest = rest.join(hint, F.col("key") == F.col("_key"), "left_anti")
    rest = rest.repartition(n_partitions(spark), "key").sortWithinPartitions("key")
    out = rest.mapInArrow(cold, "u bigint, v bigint")
    if not n:
        return out

    def hot(t: pa.Table) -> pa.Table:
        side, i, j, node, lanes = _columns(t, ("side", "i", "j", "node", "lanes"))
        one = side == i
        a = (node[one], lanes[one])
        u, v = _across(a, a if i[0] == j[0] else (node[~one], lanes[~one]), most)
        tidy()
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    dealt = keyed.select(*has).join(hint, F.col("key") == F.col("_key"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    dealt = dealt.select(*has, "side", F.least("side", "mate").alias("i"), F.greatest("side", "mate").alias("j"))
    return out.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(hot, "u bigint, v bigint"))


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): links between the distinct fingerprints of nodes (fp), thinned to forests."""
    keyed = nodes.select(F.col("fp").alias("node"), F.explode(F.array(*variant_keys(bits))).alias("key"))
    return meetings(keyed, bits, "variants")


def dedup(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of docs (doc_id, text)."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, bits))
    linked = named_roots(nodes.select(F.col("fp").alias("node"), "first_id"), roots, "first_id", "roots")
    linked = linked.withColumnRenamed("node", "fp")
    named = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("low", "first_id").alias("component_id"))
    return classed(marked, named, "fp", "classes").select("doc_id", "fp", "component_id")


# --- near copies by similarity ---------------------------------------------------------------
#
# Two texts are near copies if the Jaccard similarity of their sets of shingles is at least
# `similarity`, computed from the sets. Candidates come in two ways. The first is the method above:
# fingerprints, their deletion variants and `links` at BITS bits. The links found are tested on
# the sets. It finds no more than half of the pairs at a similarity of 0.8, so the second is an exact
# prefix filter for what is left: with all shingles in one order, two sets of similarity t share one
# of the first n - ceil(t n) + 1 shingles of each (n: its size), whatever their sizes, and where
# they share their first one enough of both is left. Any order gives the same result; common
# shingles come last in it (by their counts in a sample of texts), so that keys are rare. A key
# with over GROUP sets is hot: its sets are compared with a few leaders first, and then with all
# that are not yet in one component, in tiles.
#
# Before sets are compared, candidates are sorted out by SimHash sketches of 64 * LANES bits. A bit
# differs with a probability of at most 0.1875 (sets of 4 and 5 shingles; 0.156 from 32 shingles on)
# where the similarity is 0.8, so a pair that is similar has over `_far` differing bits with a
# probability under 1e-10. Everything else is exact.

NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Texts sampled for the order, the least count there of a common shingle and how many of them
#: are told apart; sets under a key up to which all its pairs are candidates at once; bits of
#: the filter that sorts out sets of no candidate.
ORDER_SAMPLE, COMMON, COMMONS, GROUP, FILTER_BITS = 8192, 4, 1 << 16, 16, 1 << 24
#: Leaders of a hot key, turns in which the rest of its rows meet, and the pairs of a row that each
#: turn but the last gives at most.
LEADERS, TURNS, AFEW = 8, 2, 16
#: Hot keys of a set before one of them that are looked at, so that a pair comes by few of its keys.
BEFORE = 4
#: 64-bit lanes of a sketch, and shingles whose bits are counted at once (16 bits a count).
LANES, _COUNTED = 8, (1 << 16) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EPS = 1e-6


def shingle_sets(text: pa.Array, shingle: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of lower-cased words. A text with fewer
    words has its whole sequence as its one shingle, an empty one the number 0."""
    w, counts = word_hashes(*text_buffer(pc.utf8_lower(text)))
    start = np.cumsum(counts) - counts
    h, short = w.copy(), {}
    for k in range(1, shingle):
        for r in np.flatnonzero(counts == k).tolist():
            short[r] = h[start[r] : start[r] + 1].copy()
        m = max(len(w) - k, 0)
        h[:m] = mix64(h[:m] * _ODD + w[k : k + m])
    none = np.zeros(1, np.uint64)
    return [np.unique(h[a : a + n - shingle + 1]) if n >= shingle else short.get(r, none) for r, (a, n) in enumerate(zip(start.tolist(), counts.tolist()))]


def _node(shingles: np.ndarray) -> int:
    """The hash of a sorted set of shingles, as a signed long."""
    h = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash bits of sets of hashes, as LANES numbers of 64 bits each."""
    out = np.zeros((len(sets), LANES), np.uint64)
    off = np.cumsum([0, *map(len, sets)])
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(off, off[a] + _COUNTED, "right")) - 1)
        h = np.concatenate(sets[a:b])
        start = off[a:b] - off[a] if b - a > 1 else np.arange(0, len(h), _COUNTED)
        for lane in range(LANES):
            x = mix64(h + np.uint64(int(_ODD) * (lane + 1) % (1 << 64)))
            count = np.zeros((len(start), 64), np.int64)
            for i in range(16):  # four counts of 16 bits in each number
                four = np.add.reduceat((x >> np.uint64(i)) & np.uint64(0x0001000100010001), start)
                count[:, i::16] = four[:, None] >> np.array([0, 16, 32, 48], np.uint64) & np.uint64(0xFFFF)
            if b - a == 1:
                count = count.sum(0, keepdims=True)
            more = count * 2 > np.diff(off[a : b + 1])[:, None]
            out[a:b, lane] = np.packbits(more, axis=1, bitorder="little").view(np.uint64)[:, 0]
        a = b
    return out


def _lanes(col: pa.Array) -> np.ndarray:
    """Sketches held as binary values, one row each."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), LANES)


def _far(n, m):
    """Differing bits of two sketches of sets of n and m shingles up to which they can be similar."""
    return np.where(np.minimum(n, m) < 32, 157, 136)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (sorted) and their counts in a sample of docs (text, digest)."""
    every = max(1, docs.count() // ORDER_SAMPLE)

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(0), shingle)
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64))], names=["h"])

    some = docs.where(F.pmod("digest", F.lit(every)) == 0).select("text").mapInArrow(run, "h bigint")
    found = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(COMMONS).collect()
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _in_order(sets: list[np.ndarray], common: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The sets by count, then hash: shingles that are not common come first."""
    if not len(common) or not sets:
        return sets
    h = np.concatenate(sets)
    at = np.searchsorted(common, h)
    at[at == len(common)] = 0
    n = np.where(common[at] == h, count[at], 0)
    cut = np.cumsum([len(s) for s in sets])[:-1]
    return [s[np.lexsort((s, c))] if c.any() else s for s, c in zip(sets, np.split(n, cut))]


def _enough(n, i, m, j, similarity: float):
    """Whether sets of n and m shingles whose first common one is at places i and j can be
    similar."""
    return np.minimum(n - i, m - j) >= (n + m) * (similarity / (1 + similarity)) - _EPS


def _pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Pairs u < v of sizes that can be similar under equal keys of rows sorted by key, each
    once: u, v, their sizes and the number of keys they share here."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    stop = np.append(first[1:], len(key))
    end = np.repeat(stop, stop - first)
    rows, found, d = np.arange(len(key)), [np.zeros((0, 4), np.int64)], 1
    while True:
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        m, most = np.minimum(n[rows], n[rows + d]), np.maximum(n[rows], n[rows + d])
        a = rows[m >= most * similarity - _EPS]
        swap = node[a] > node[a + d]
        x, y = np.where(swap, a + d, a), np.where(swap, a, a + d)
        found.append(np.stack([node[x], node[y], n[x], n[y]], 1))
        d += 1
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort((all_[:, 1], all_[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (all_[1:, :2] != all_[:-1, :2]).any(1)])) if len(all_) else np.zeros(0, np.int64)
    return [*all_[new].T, np.diff(np.append(new, len(all_)))]


def _cold_pairs(keyed: DataFrame, hot: DataFrame | None, similarity: float) -> DataFrame:
    """(u, v, n, m): candidates among rows of keyed (key, node, n), of which hot (node) are under hot
    keys. Up to where the shorter of two prefixes ends, all common shingles are known: the keys
    the two share. Past it, at most the rest of one of them is common."""
    names = ["u", "v", "n", "m", "c"]

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False).copy() for c in range(3)])
            size += b.num_rows
            if size < _BUFFER // 2:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            at = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key can go on
            held, size = [[x[at:].copy() for x in rows]], size - at
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(*(x[:at] for x in rows), similarity)], names=names)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(*(np.concatenate(x) for x in zip(*held)), similarity)], names=names)
        tidy()

    rows = keyed.select("key", "node", F.col("n").cast("long").alias("n")).repartition(n_partitions(keyed.sparkSession), "key").sortWithinPartitions("key")
    met = rows.mapInArrow(run, "u bigint, v bigint, n bigint, m bigint, c bigint")
    met = met.groupBy("u", "v").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("c").alias("c"))
    rest = F.greatest(F.ceil(F.col("n") * similarity - _EPS), F.ceil(F.col("m") * similarity - _EPS)) - 1
    least = (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - _EPS - rest
    if hot is None:
        return met.where(F.col("c") >= least).select("u", "v", "n", "m")
    more = hot.groupBy("node").agg(F.count("*").alias("h"))
    for end in ("u", "v"):
        met = met.join(more.select(F.col("node").alias(end), F.col("h").alias(f"h{end}")), end, "left")
    return met.where(F.col("c") + F.least(F.coalesce("hu", F.lit(0)), F.coalesce("hv", F.lit(0))) >= least).select("u", "v", "n", "m")


def _variant_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v, n, m): candidates by the links of fingerprints (`links`), of nodes (node, size, fp). The
    least node of a fingerprint stands for it, and meets the others of its fingerprint."""
    node = nodes.select("node", "size", "fp")
    least = materialize(node.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("p"), F.count("*").alias("n")), "near-fps")
    one = lambda end: least.select(F.col("fp").alias(end), F.col("p").alias(f"p{end}"))
    across = links(least.select("fp")).distinct().join(one("u"), "u").join(one("v"), "v").select(F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b"))
    some = least.where("n > 1").select("fp", "p", "n")
    within = classed(node, some, "fp", "near-same").select("p", F.struct("node", "size").alias("b")).where("p.node != b.node").withColumnRenamed("p", "a")
    return across.unionByName(within).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.size").cast("long").alias("n"), F.col("b.size").cast("long").alias("m"))


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, d): those of pairs (u, v, n, m) whose sketches, d bits apart, are near enough."""

    def run(batches):
        for b in batches:
            d = np.bitwise_count(_lanes(b.column(4)) ^ _lanes(b.column(5))).sum(1, dtype=np.int64)
            n, m = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            ok = d <= _far(n, m)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy(zero_copy_only=False)[ok]) for c in (0, 1)] + [pa.array(d[ok])], names=["u", "v", "d"])
        tidy()

    held = lambda end: nodes.select(F.col("node").alias(end), F.col("lanes").alias(f"l{end}"))
    both = pairs.join(held("u"), "u").join(held("v"), "v").select("u", "v", "n", "m", "lu", "lv")
    return both.mapInArrow(run, "u bigint, v bigint, d bigint")


def _set_table(pairs: DataFrame, docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """(node, set) of the nodes of pairs (u, v), made anew from docs (text): the sets of all texts
    would take more room than the texts."""
    slot = F.pmod("node", F.lit(FILTER_BITS))
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    part = 1 << 15  # bits of one bitmap
    maps = ends.select(slot.alias("s")).groupBy((F.col("s") / part).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("s") % part).alias("m"))
    bits = np.zeros((FILTER_BITS // part, part // 8), np.uint8)
    for r in maps.collect():
        bits[r["b"]] = np.frombuffer(r["m"], np.uint8)
    bits = bits.reshape(-1)

    def some(batches):
        seen = set()
        for b in batches:
            sets = shingle_sets(b.column(0), shingle)
            node, keep = [_node(x) for x in sets], []
            for i, x in enumerate(node):
                if bits[(x % FILTER_BITS) >> 3] >> (x & 7) & 1 and x not in seen:
                    seen.add(x)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "set"])
            del sets
            tidy()

    return materialize(docs.select("text").mapInArrow(some, "node bigint, set binary"), f"{name}-sets")


def _similar(pairs: DataFrame, held: DataFrame, similarity: float, name: str) -> DataFrame:
    """Those of pairs (u, v) of nodes whose sets, of held (node, set), are similar."""
    since = len(_MADE)

    def run(batches):
        for b in batches:
            ok = [exact(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        tidy()

    def exact(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both) >= similarity

    sets = held.select("node", F.col("set").alias("x")).dropDuplicates(["node"])
    found = materialize(_attached(pairs, sets, f"{name}-set").mapInArrow(run, "u bigint, v bigint"), f"{name}-links")
    release(pairs.sparkSession, since, found)
    return found


def _attached(pairs: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """(u, v, x, _x): pairs (u, v) with the x of both, of held (node, x). v may end very many."""
    right = pairs.groupBy("v").agg(F.count("*").alias("n")).join(held.withColumnRenamed("node", "v"), "v")
    both = classed(pairs, right, "v", name)
    return both.join(held.select(F.col("node").alias("u"), F.col("x").alias("_x")), "u").select("u", "v", "x", "_x")


def _tested(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float, name: str, done: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(u, v): links that make the components of the similar ones of pairs (u, v, d) but for those of
    done (u, v), None if there are no such pairs; and the pairs. The nearest pair of each node is
    tested first, then those that these leave in different components."""
    spark = pairs.sparkSession
    pairs = pairs.groupBy("u", "v").agg(F.min("d").alias("d"))
    pairs = materialize(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), f"{name}-pairs")
    if done is not None and not pairs.limit(1).count():
        return None, pairs
    held = _set_table(pairs, docs, shingle, name)
    each = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
    near = each.groupBy("u").agg(F.min(F.struct("d", "v")).alias("p")).select("u", F.col("p.v").alias("v"))
    near = materialize(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-nearest")
    found = _similar(near, held, similarity, name)
    rest = _rooted(pairs.select("u", "v").join(near, ["u", "v"], "left_anti"), components(found, f"{name}-part"))
    rest = materialize(rest.where("ru != rv").select("u", "v"), f"{name}-rest")
    if rest.limit(1).count():
        found = found.unionByName(_similar(rest, held, similarity, f"{name}-more"))
    _delete(spark, held._ranksmith_path)
    return found, pairs.select("u", "v")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (u, v) with the roots ru and rv of roots (node, root); a node without one is its own."""
    for end in ("u", "v"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs


def _scored(rows: DataFrame) -> DataFrame:
    """rows (key, node, n, i, lanes, rows) with the score of each node, the rows of all its hot keys,
    and the BEFORE hot keys before each, b0 and on; 0 is none."""
    of = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("lanes").alias("lanes"), F.sum("rows").alias("score"), F.sort_array(F.collect_list(F.struct("i", "key", "rows"))).alias("ks"))
    each = of.select("node", "n", "lanes", "score", "ks", F.posexplode("ks").alias("p", "k"))
    before = [F.coalesce(F.get("ks.key", F.col("p") - 1 - b), F.lit(0)).alias(f"b{b}") for b in range(BEFORE)]
    return each.select("k.key", "node", "n", "k.i", "lanes", "k.rows", "score", *before)


def _star(rows: DataFrame, n_keys: int, similarity: float) -> DataFrame:
    """(u, v, d): each of rows (key, node, n, i, lanes, score) with the nearest of the LEADERS of its key
    that it can be similar to. Leaders are the first by score, then hash: a text that others were
    made of has the most hot keys, its own are theirs."""
    by = Window.partitionBy("key").orderBy(F.col("score").desc(), F.xxhash64("node"), "node")
    top = rows.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= LEADERS)
    top = top.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("node", "n", "i", "lanes")).alias("p"))
    hint = F.broadcast(top) if n_keys * LEADERS <= BROADCAST_KEYS else top

    def run(batches):
        for b in batches:
            node, n, i = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            p = b.column(4)
            at = np.repeat(np.arange(b.num_rows), pc.list_value_length(p).to_numpy(zero_copy_only=False))
            p = p.flatten()
            pn, pm, pi = (pc.struct_field(p, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("node", "n", "i"))
            d = np.bitwise_count(_lanes(b.column(3))[at] ^ _lanes(pc.struct_field(p, "lanes"))).sum(1, dtype=np.int64)
            ok = np.flatnonzero((node[at] != pn) & (d <= _far(n[at], pm)) & _enough(n[at], i[at], pm, pi, similarity))
            ok = ok[np.lexsort((d[ok], at[ok]))]
            ok = ok[np.diff(at[ok], prepend=-1) > 0]
            u, v = node[at[ok]], pn[ok]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(u, v), np.maximum(u, v), d[ok])], names=["u", "v", "d"])
        tidy()

    met = rows.join(hint, F.col("key") == F.col("_key")).select("node", "n", "i", "lanes", "p")
    return met.mapInArrow(run, "u bigint, v bigint, d bigint")


def _cross(left: DataFrame, most: int | None, similarity: float) -> DataFrame:
    """(u, v, d, c): pairs of left (key, node, n, i, lanes, root, main, rows) with one key and two roots that
    can be similar, the `most` nearest of each row, of c in all. Rows of the most frequent
    component stay where they are, in tiles; the others go to each tile. A pair that shares one of
    the hot keys just before meets under that key as well, and is left to it: by the first key that
    two rows share they always come."""
    cut = left.withColumn("tiles", F.ceil(F.col("rows") / TILE).cast("int"))
    own = cut.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    away = cut.where("root != main").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    has = ["key", "tile", "visits", "node", "n", "i", "root", F.expr("root = main").alias("is_main"), "lanes", *(f"b{b}" for b in range(BEFORE))]
    both = own.withColumn("visits", F.lit(False)).select(*has).unionByName(away.withColumn("visits", F.lit(True)).select(*has))
    both = both.repartition(n_partitions(left.sparkSession), "key", "tile").sortWithinPartitions("key", "tile", "visits")

    def group(visits, node, n, i, root, is_main, lanes, before):
        k = int(np.searchsorted(visits, True))  # those of the tile, then those that visit it
        size = max(1, (1 << 21) // max(1, k))
        for a in range(k, len(node), size):
            z = slice(a, a + size)
            ok = (root[z, None] != root[None, :k]) & (is_main[None, :k] | (node[z, None] < node[None, :k]))
            ok &= _enough(n[z, None], i[z, None], n[None, :k], i[None, :k], similarity)
            x, y = np.nonzero(ok)
            d = np.bitwise_count(lanes[a + x] ^ lanes[y]).sum(1, dtype=np.int64)
            near = d <= _far(n[a + x], n[y])
            x, y, d = a + x[near], y[near], d[near]
            one, two = before[x][:, :, None], before[y][:, None, :]
            new = ~((one == two) & (one != 0)).any((1, 2))
            x, y, d = x[new], y[new], d[new]
            c = np.bincount(x, minlength=len(node))[x]
            if most is not None and len(x):
                o = np.lexsort((d, x))
                x, y, d, c = x[o], y[o], d[o], c[o]
                first = np.flatnonzero(np.diff(x, prepend=-1))
                place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
                x, y, d, c = (w[place < most] for w in (x, y, d, c))
            if len(x):
                yield np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), d, c

    def groups(cols):
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        at = np.concatenate([[0], np.flatnonzero(new) + 1, [len(cols[0])]])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if cols[2][b - 1] and b - a > 1:
                yield from group(*(c[a:b] for c in cols[2:]))

    def run(batches):
        held, size = [], 0
        for b in _ended(batches):
            if b is not None:
                held.append([b.column(c).to_numpy(zero_copy_only=False).copy() for c in range(8)] + [_lanes(b.column(8)), np.stack([b.column(9 + c).to_numpy(zero_copy_only=False) for c in range(BEFORE)], 1)])
                size += b.num_rows
                if size < _BUFFER // 2:
                    continue
            if not size:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            at = len(last) if b is None else int(np.argmax(last))  # the last group can go on
            held, size = [[x[at:].copy() for x in cols]], size - at
            found = list(groups([x[:at] for x in cols])) if at else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["u", "v", "d", "c"])
        tidy()

    return both.mapInArrow(run, "u bigint, v bigint, d bigint, c bigint")


def _ended(batches):
    yield from batches
    yield None


def _near_links(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links that make the components of nodes (node, size, fp, lanes, keys: the first
    shingles)."""
    spark = nodes.sparkSession
    keyed = nodes.select("node", F.col("size").alias("n"), F.posexplode("keys").alias("i", "key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP).withColumnRenamed("key", "_key")
    many = materialize(many, "near-hot")
    n_hot = many.count()
    variants = materialize(_variant_pairs(nodes), "near-variants")
    if not n_hot:
        cold = _cold_pairs(keyed, None, similarity)
        return _tested(_sketched(variants.unionByName(cold), nodes), docs, shingle, similarity, "near")[0]
    hint = F.broadcast(many) if n_hot <= BROADCAST_KEYS else many
    on = F.col("key") == F.col("_key")
    since = len(_MADE)
    wide = nodes.select("node", F.col("size").alias("n"), "lanes", F.posexplode("keys").alias("i", "key"))
    rows = materialize(wide.join(hint, on).drop("_key"), "near-hot-rows")
    hot = materialize(_scored(rows), "near-hot-scored")
    release(spark, since, hot)
    cold = _cold_pairs(keyed.join(hint, on, "left_anti"), hot, similarity)
    first = _sketched(variants.unionByName(cold), nodes).unionByName(_star(hot, n_hot, similarity))
    links, done = _tested(first, docs, shingle, similarity, "near")

    # What is left of the hot keys: the pairs across components.
    for turn in range(1, TURNS + 1):
        left, n_main = _apart_rows(hot, links, turn)
        if not n_main:
            return links
        few = max(1, int(AFEW))
        more = materialize(_cross(left, None if turn == TURNS else few, similarity), f"near-cross{turn}")
        most = more.agg(F.max("c")).first()[0]
        if most is None:
            return links
        found, pairs = _tested(more, docs, shingle, similarity, f"near-{turn}", done)
        if found is not None:
            links = links.unionByName(found)
        if most <= few:  # no pair was left for another turn
            return links
        done = done.unionByName(pairs)
    return links


def _apart_rows(hot: DataFrame, links: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """The rows of hot whose key has more than one component of links, with root and main (the
    key's most frequent root), and how many such keys there are."""
    roots = components(links, f"near-cc{turn}").withColumnRenamed("node", "_node")
    placed = materialize(hot.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node", "score"), "near-placed")
    each = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = each.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).where("m.c < all")
    main = materialize(main.select(F.col("key").alias("_key"), F.col("m.root").alias("main")), "near-main")
    n = main.count()
    left = placed.join(F.broadcast(main) if n <= BROADCAST_KEYS else main, F.col("key") == F.col("_key"))
    return left.select("key", "node", "n", "i", "rows", "root", "main", "lanes", *(f"b{b}" for b in range(BEFORE))), n


def _near_classes(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, node) of each of docs (doc_id, text), and (node, n, first, component) of
    each node: texts with the same shingles. first is (null id?, doc_id, digest), the least of
    the node; component is the least first of all that are linked."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest().alias("digest"))
    common, count = _common(src.select("text", "digest"), shingle)

    def marks(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), shingle)
            node = pa.array([_node(s) for s in sets], pa.int64())
            lanes = pa.array([x.tobytes() for x in sketches(sets)], pa.binary())
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1).cast(pa.large_binary())), np.uint64, b.num_rows)
            sets = _in_order(sets, common, count)
            keys = [s[: len(s) - math.ceil(similarity * len(s) - _EPS) + 1].view(np.int64) for s in sets]
            off = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            size = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), node, size, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int64())), pa.array(fp.view(np.int64)), lanes], names=["doc_id", "digest", "node", "size", "keys", "fp", "lanes"])
            del sets, keys, flat
            tidy()

    marked = src.mapInArrow(marks, "doc_id bigint, digest bigint, node bigint, size int, keys array<bigint>, fp bigint, lanes binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    nodes = marked.groupBy("node").agg(first, F.count("*").alias("n"), F.min("size").alias("size"), F.min("keys").alias("keys"), F.min("fp").alias("fp"), F.min("lanes").alias("lanes"))
    nodes = materialize(nodes, "near-nodes")
    roots = components(_near_links(nodes, src, shingle, similarity), "near-cc")
    linked = named_roots(nodes.select("node", "first"), roots, "first", "near-roots")
    return marked, nodes.select("node", "n", "first").join(linked, "node", "left").select("node", "n", "first", F.coalesce("low", "first").alias("component"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(doc_id, component_id) of docs (doc_id, text): components of texts whose shingles are
    similar. An empty text is one like any other."""
    marked, classes = _near_classes(docs, similarity, shingle)
    named = classes.select("node", "n", F.col("component.doc_id").alias("component_id"))
    return classed(marked.select("doc_id", "node"), named, "node", "near-classes").select("doc_id", "component_id")


def _digest():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest doc_id (null:
    last). Rows are told apart by doc_id and text, so different texts under one doc_id, or none,
    are each judged."""
    _, classes = _near_classes(docs.select("doc_id", "text"), similarity, NEAR_SHINGLE)
    own = F.struct("*").alias("row")  # the columns of docs can have any names
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id")
    kept = classes.where("first = component").select("first.*").select(id_, "digest")
    one = docs.select(own, id_, _digest().alias("digest"), F.xxhash64(*docs.columns).alias("h")).join(kept, ["id", "digest"])
    # Rows that repeat both: one of them stays, the same one in every run.
    pick = Window.partitionBy("id", "digest").orderBy("h")
    return one.withColumn("place", F.row_number().over(pick)).where("place = 1").select("row.*")


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
