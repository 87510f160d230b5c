"""Token counts by a separator scan over flat, unindexed token files.

A token file is a sequence of 16- or 32-bit identifiers, documents closed by an end-of-document
identifier, with no index. It is read as blocks (file, block, data) of whole identifiers, cut
anywhere. Each block is searched for the separator by one whole-array comparison and gives the
lengths between separators; a prefix scan of the separators per block numbers the documents of
a file, and the open ends of neighbouring blocks meet under the same number and are added.

encode() writes such files from texts with a public byte-pair vocabulary (its path is a
parameter). Null and empty texts are documents of 0 tokens. A file that doesn't end with a
separator has a last document all the same (closed false); an empty file has none. The windows
hold one small row a block, never the data. Repeated rows are documents of their own, null ids
are kept, extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import base64
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, tidy

BLOCK = 1 << 16
EOD = 50256
BLOCKS = "file int, block int, data binary, doc_ids array<bigint>"


def _encoder(vocabulary: str | None):
    kept = sys.__dict__.setdefault("_ranksmith_bpe", {})
    if vocabulary not in kept:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[vocabulary] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[vocabulary]


def encode(docs: DataFrame, vocabulary: str | None = None, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """Flat files of docs (doc_id, text), one a partition, as blocks of `block` identifiers of
    16 bits. doc_ids names the documents closed in a block: the scan doesn't use it, it only
    labels results."""
    docs = docs.select(F.spark_partition_id().alias("file"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        bpe = _encoder(vocabulary)
        tail, ids, n, file = np.zeros(0, np.uint16), [], 0, None
        closed_at: list[int] = []  # place of each id's separator, from the start of tail

        def cut(parts, last):
            nonlocal tail, ids, closed_at, n
            flat = np.concatenate(parts)
            stop = len(flat) if last else len(flat) // block * block
            cols: tuple[list, ...] = ([], [], [], [])
            at = np.searchsorted(np.array(closed_at), np.arange(0, stop + block, block)).tolist() if closed_at else [0] * (stop // block + 2)
            for k, a in enumerate(range(0, stop, block)):
                for c, x in zip(cols, (file, n, flat[a : min(a + block, stop)].tobytes(), ids[at[k] : at[k + 1]])):
                    c.append(x)
                n += 1
            done = int(np.searchsorted(closed_at, stop)) if closed_at else 0
            tail, ids, closed_at = flat[stop:], ids[done:], [x - stop for x in closed_at[done:]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], names=["file", "block", "data", "doc_ids"])

        for b in batches:
            parts, size = [tail], len(tail)
            for row, (i, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                file = b.column(0)[0].as_py()
                tokens = bpe.encode_ordinary(t.as_py() or "")
                tokens.append(eod)
                parts.append(np.array(tokens, np.uint16))
                size += len(tokens)
                ids.append(i)
                closed_at.append(size - 1)
                if size > 64 * block:
                    yield cut(parts, False)
                    parts, size = [tail], len(tail)
            yield cut(parts, False)
            tidy()
        if len(tail):
            yield cut([tail], True)

    return docs.mapInArrow(run, BLOCKS)


def read_flat(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of binary token files under path (files of up to 2 GB, Spark's limit for a row)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                raw = memoryview(data.as_buffer())
                step = block * width
                cuts = range(0, len(raw), step)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cuts), pa.string()), pa.array(range(len(cuts)), pa.int32()), pa.array([bytes(raw[a : a + step]) for a in cuts], pa.binary())], names=["file", "block", "data"])

    return files.mapInArrow(run, "file string, block int, data binary")


def scan(blocks: DataFrame, eod: int = EOD, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in blocks (file, block, data), and
    doc_id if the blocks carry doc_ids."""
    labelled = "doc_ids" in blocks.columns
    cols = ["file", "block", *(["doc_ids"] if labelled else []), "data"]
    src = blocks.select(*cols)
    dtype = np.dtype(f"<u{width}")

    def run(batches):
        for b in batches:
            lengths, seps = [], []
            for data in b.column(b.num_columns - 1):
                ids = np.frombuffer(data.as_buffer(), dtype) if data.is_valid else np.zeros(0, dtype)
                at = np.flatnonzero(ids == eod)
                edge = np.concatenate([[-1], at, [len(ids)]])
                lengths.append(np.diff(edge) - 1)
                seps.append(len(at))
            flat = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            off = np.cumsum([0, *map(len, lengths)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int64())), pa.array(seps, pa.int64())], names=[*cols[:-1], "lengths", "seps"])

    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in cols[:-1])
    found = src.mapInArrow(run, f"{kinds}, lengths array<bigint>, seps bigint")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    part = found.select(*cols[:-1], "base", "seps", F.posexplode("lengths").alias("k", "n"))
    # The piece after a block's last separator is empty when the next document starts a block.
    part = part.where("k < seps OR n > 0").withColumn("closes", F.col("k") < F.col("seps"))
    aggs = [F.sum("n").alias("n_tokens"), F.bool_or("closes").alias("closed")]
    if labelled:
        aggs.append(F.max(F.when(F.col("closes"), F.get("doc_ids", F.col("k")))).alias("doc_id"))
    return part.groupBy("file", (F.col("base") + F.col("k")).alias("ordinal")).agg(*aggs)


def op7_token_count(spark, sf_dir: str) -> DataFrame:
    """Documents written as flat token files in the shared folder, then counted by the scan."""
    files = materialize(encode(table(spark, sf_dir, "documents").select("doc_id", "text")), "flat-tokens")
    return scan(files).select("doc_id", "file", "ordinal", "n_tokens")
