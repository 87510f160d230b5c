"""Language-model scoring by a weighted backoff automaton, sharded over the cluster.

Tokens are the lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` of a text and then one end. The
model is an n-gram model of order ORDER by deleted interpolation: with c the training count of an
n-gram, u a context, N training tokens and V distinct ones,

    p1(w)   = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w|u)  = (1 - b(u)) c(uw) / c(u) + b(u) p(w|u')        u' : u without its first token

Seen contexts are states, seen n-grams arcs, and b(u) is the weight of the failure arc to u'. It
is smoothed from counts: contexts of one length are put in classes by floor(log2 c(u)), and b of a
class is (s + 0.5) / (t + 1), with t the training tokens read in its contexts and s those whose
n-gram occurs that one time, which would be unseen had they been left out. No n-gram is pruned
and no statistic is taken from a sample. Texts are walked once, left to right: the state carries
what is known of the contexts that end at the last token, each step takes an arc or fails to the
shorter context, and log-probabilities are added up. A long text is walked in segments of SEGMENT
tokens that start in the state that their two tokens before lead to.

The automaton grows with the corpus, so it is never in one place. Texts are packed in blocks of
about BLOCK_BYTES; a block sends each distinct n-gram key once with its training count to the
shard that owns that key range; the shard sums over blocks and answers every block with the totals
in the order asked. The block then holds exactly the arcs its texts can use, keeps their counts a
token, and is walked when the classes' weights are known. Blocks and shards (SHARD_BYTES of text
each) grow in number, not in size; a hot word is one key a block, so no shard is hot. Keys are
hashes: of 63 bits for words, and for longer n-grams of as many as keep the chance that one shares
its key with another near one in 2**18, 63 at most.

Nulls and empty texts are one end token. A null doc_id is never trained on (held_out true).
Repeated rows are scored, and counted, each. Extra columns are ignored. An empty table gives
an empty result. A text of any length is scored whole; a block holds at least one whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, n_partitions, table, text_buffer, tidy, word_hashes

END = np.uint64(0x1F83D9ABFB41BD6B)
BEGIN = np.uint64(0x5BE0CD19137E2179)
_STEP = np.uint64(0xD6E8FEB86659FD93)
ADD = 0.1
ORDER, SEGMENT = 3, 512
BLOCK_BYTES, SHARD_BYTES = 10 << 20, 24 << 20
#: Classes of context counts.
CLASSES = 64


def token_stream(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of all rows one after another, each row closed by END, and tokens per row."""
    words, counts = word_hashes(buf, offsets)
    n = counts + 1
    stop = np.cumsum(n)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[stop - 1] = True
    out[is_end] = END
    out[~is_end] = words
    return out, n


def ngram_keys(tokens: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for 1..order; BEGIN stands before a row.
    Where a row is too short for the order the key repeats that of the order below."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    pos = np.arange(len(tokens)) - np.repeat(first, n)
    keys = [tokens]
    for level in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = keys[-1][:-1]
        if level == 2:
            before[first] = BEGIN
        key = mix64(before * _STEP + tokens + np.uint64(level))
        keys.append(np.where(pos >= level - 2, key, keys[-1]))
    return keys


_ZSTD = {"level": 1}


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, their bytes plane by plane: the high ones compress."""
    d = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), **_ZSTD)


def _unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.view(np.uint64).ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    kind = next(k for k in ("u1", "u2", "u4", "u8") if int(x.max(initial=0)) < 1 << 8 * int(k[1]))
    return kind.encode() + zstandard.compress(x.astype(kind).tobytes(), **_ZSTD)


def _large(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[2:]), blob[:2].decode()).astype(np.int64)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (of 63 bits at most) in order and how many of each are training tokens."""
    both = np.sort(keys << np.uint64(1) | (~train).astype(np.uint64))
    key = both >> np.uint64(1)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(1 - (both & np.uint64(1)).astype(np.int64), new)


def _bits(level: int, bits: int) -> int:
    """Bits of the keys of a level: words have all that there is room for."""
    return bits if level else 63


def _edges(uniq: np.ndarray, shards: int, bits: int) -> np.ndarray:
    bounds = np.array([(i << bits) // shards for i in range(shards)], np.uint64)
    return np.append(np.searchsorted(uniq, bounds), len(uniq))


def _blocks(batches):
    """Texts packed in rows of about BLOCK_BYTES: (block, data), data as compressed Arrow."""
    part, seq = TaskContext.get().partitionId(), 0
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def packed(held):
        nonlocal seq
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as w:
            for b in held:
                w.write_batch(b)
        seq += 1
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    held, size = [], 0
    for b in batches:
        off = text_buffer(b.column(1))[1]
        a = 0
        while a < b.num_rows:
            z = int(np.searchsorted(off, off[a] + BLOCK_BYTES - size, "right")) - 1
            z = min(max(z, a + (not held)), b.num_rows)
            if z > a:
                held.append(b.slice(a, z - a))
                size += int(off[z] - off[a])
            if size >= BLOCK_BYTES or z < b.num_rows:
                yield packed(held)
                held, size = [], 0
            a = z
    if held:
        yield packed(held)
    tidy()


def _texts(t: pa.Table) -> pa.Table:
    with pa.ipc.open_stream(t["data"][0].as_buffer()) as r:
        return r.read_all()


def _ask(order: int, shards: int, bits: int):
    """A block's rows for the shards of each level; shard numbers go on from level to level."""

    def ask(t: pa.Table) -> pa.Table:
        block, texts = t["block"][0].as_py(), _texts(t)
        tokens, n = token_stream(*text_buffer(texts["text"]))
        train = np.repeat(~texts["held_out"].to_numpy(), n)
        rows = []
        for level, keys in enumerate(ngram_keys(tokens, n, order)):
            uniq, count = _counted(keys >> np.uint64(64 - _bits(level, bits)), train)
            cut = _edges(uniq, shards, _bits(level, bits))
            rows += [(level * shards + s, block, _pack(uniq[a:b]), _small(count[a:b])) for s, a, b in zip(range(shards), cut, cut[1:]) if b > a]
        tidy()
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())))})

    return ask


def _answer(t: pa.Table) -> pa.Table:
    keys = [_unpack(x) for x in t["keys"].to_pylist()]
    counts = np.concatenate([_large(x) for x in t["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, counts).astype(np.int64)[inverse]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    tidy()
    return pa.table({"block": t["block"], "shard": t["shard"], "totals": pa.array([_small(x) for x in np.split(total, cut)], pa.binary())})


def _class(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(float))[1] - 1


def contexts(count: list[np.ndarray], n: np.ndarray, begin: int, level: int) -> np.ndarray:
    """Training count of the context of `level` tokens before each token; 0 where a text is too
    short for it. count[k] has that of the (k+1)-gram that ends at each token."""
    first = np.cumsum(n) - n
    out = np.zeros(len(count[0]), np.int64)
    out[1:] = count[level - 1][:-1]
    out[first] = begin if level == 1 else 0
    for k in range(1, level - 1):  # the level-gram that ends at place k - 1 is cut by the start
        out[(first + k)[n > k]] = 0
    return out


def statistics(count: list[np.ndarray], n: np.ndarray, begin: int, train: np.ndarray) -> np.ndarray:
    """What adds up to the model's weights: training tokens and types, and for each context
    length and class the tokens read in training and those seen that one time."""
    out = [np.array([train.sum(), (1.0 / count[0][train]).sum()])]
    for level in range(1, len(count)):
        state = contexts(count, n, begin, level)
        at = train & (state > 0)
        cls = _class(state[at])
        out += [np.bincount(cls, minlength=CLASSES), np.bincount(cls, count[level][at] == 1, CLASSES)]
    return np.concatenate(out).astype(float)


def failure_weights(stats: np.ndarray) -> np.ndarray:
    """b of each context length (rows) and class (columns), from statistics without its first two."""
    by = stats.reshape(-1, 2, CLASSES)
    return (by[:, 1] + 0.5) / (by[:, 0] + 1)


def traverse(count: list[np.ndarray], n: np.ndarray, begin: int, train_tokens: int, types: int, fail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities (root state only, whole automaton) of every text. All segments of texts
    are walked together, one token a step; the state is the counts of the contexts held."""
    per = -(-n // SEGMENT)
    of = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    start = (np.cumsum(n) - n)[of] + k * SEGMENT
    size = np.minimum(SEGMENT, n[of] - k * SEGMENT)
    order = np.argsort(-size, kind="stable")
    of, start, size = of[order], start[order], size[order]
    state = [contexts(count, n, begin, level)[start] for level in range(1, len(count))]
    root, own = np.zeros(len(of)), np.zeros(len(of))
    for j in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -j, "left"))  # segments of over j tokens
        at = start[:m] + j
        p = (count[0][at] + ADD) / (train_tokens + ADD * (types + 1))
        root[:m] += np.log10(p)
        for level, held in enumerate(state, 1):
            s = held[:m]
            b = fail[level - 1][_class(np.maximum(s, 1))]
            p = np.where(s > 0, (1 - b) * count[level][at] / np.maximum(s, 1) + b * p, p)
        own[:m] += np.log10(p)
        # What was read last is the context now. A context that a text's start cuts short has
        # been none so far, and the next longer one stays none.
        seen = [True, *(held[:m] > 0 for held in state[:-1])]
        for level, known in enumerate(seen):
            state[level][:m] = np.where(known, count[level][at], 0)
    out = np.zeros((2, len(n)))
    np.add.at(out[0], of, root)
    np.add.at(out[1], of, own)
    return out[0], out[1]


_COUNTED = "docs binary, counts array<binary>, ends bigint, stats array<double>"


def _count(order: int, shards: int, bits: int):
    def count(packed: pa.Table, totals: pa.Table) -> pa.Table:
        texts = _texts(packed)
        tokens, n = token_stream(*text_buffer(texts["text"]))
        by = dict(zip(totals["shard"].to_pylist(), totals["totals"].to_pylist()))
        found, ends = [], 0
        for level, keys in enumerate(ngram_keys(tokens, n, order)):
            uniq, where = np.unique(keys >> np.uint64(64 - _bits(level, bits)), return_inverse=True)
            total = np.concatenate([_large(by[s]) for s in range(level * shards, (level + 1) * shards) if s in by])
            if len(total) != len(uniq):
                raise ValueError("a block's answers do not match what it asked for")
            found.append(total[where])
            if not level:
                ends = int(total[np.searchsorted(uniq, END >> np.uint64(1))])
        train = np.repeat(~texts["held_out"].to_numpy(), n)
        stats = statistics(found, n, ends, train)
        sink = pa.BufferOutputStream()
        docs = pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n": pa.array(n, pa.int64())})
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        tidy()
        cols = ([sink.getvalue().to_pybytes()], pa.binary()), ([[_small(x) for x in found]], pa.list_(pa.binary())), ([ends], pa.int64()), ([stats], pa.list_(pa.float64()))
        return pa.table({k: pa.array(*v) for k, v in zip(("docs", "counts", "ends", "stats"), cols)})

    return count


def _score(train_tokens: int, types: int, fail: np.ndarray):
    def score(batches):
        for b in batches:
            for i in range(b.num_rows):
                with pa.ipc.open_stream(b.column("docs")[i].as_buffer()) as r:
                    docs = r.read_all()
                n = docs["n"].to_numpy()
                count = [_large(x.as_py()) for x in b.column("counts")[i].values]
                root, own = traverse(count, n, b.column("ends")[i].as_py(), train_tokens, types, fail)
                known = np.add.reduceat((count[0] > 0).astype(np.int64), np.cumsum(n) - n)
                out = {"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(n), train_tokens), pa.int64()), "base_score": pa.array(root), "score": pa.array(own)}
                tidy()
                yield from pa.table(out).to_batches()

    return score


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_ASKED = "shard int, block bigint, keys binary, counts binary"


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of docs (doc_id, text, held_out): the model learns from the rows not held out.

    Three jobs: the size of the texts; the counts a token of every block, kept as a table; and
    the walk. The packed texts are shuffled once and that exchange is used for both of its parts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(n_partitions(spark), -(-size // SHARD_BYTES))
    bits = min(63, max(40, (size // 6).bit_length() + 18))  # a token is 6 bytes or so
    packed = docs.mapInArrow(_blocks, "block bigint, data binary")
    asked = packed.groupBy("block").applyInArrow(_ask(order, shards, bits), _ASKED)
    answers = asked.groupBy("shard").applyInArrow(_answer, "block bigint, shard int, totals binary")
    found = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_count(order, shards, bits), _COUNTED)
    found = materialize(found, "lm-counts")
    stats = found.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    stats = np.array([r["x"] for r in stats]) if stats else np.zeros(2 + 2 * CLASSES * (order - 1))
    return found.mapInArrow(_score(int(stats[0]), round(stats[1]), failure_weights(stats[2:])), RESULT)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32(doc_id as text) mod 10 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    return score_texts(docs.withColumn("held_out", held))
