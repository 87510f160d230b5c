"""Embedding near-duplicates by PCA-ordered tiled comparison.

All vectors are compared by cosine in double precision. Equal vectors are one class from the
start. Vectors are rotated into a principal basis (fitted on a bounded sample, SAMPLE vectors;
any orthonormal basis gives the same products, so the sample only sets the order), which puts
most of their length into the leading dimensions. Tiles of about TILE classes are cut by range
of the first coordinate and, within a range, by hash. A pair of tiles is compared block by
block: the leading LEAD dimensions are multiplied first; the rest of a product is at most the
product of the suffix norms, so a block whose sums plus bounds stay below the threshold stops
there, and else only its rows and columns that can still reach it go on. Sums within 1e-9 of
the threshold are decided again from the vectors as given.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so ranges further apart than that are never
paired. A pair of tiles gives each class's number of linked vectors and a spanning forest of
the links, never the pairs themselves; components() joins the forests.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing
(n_links 0, their own component, kept); so do rows with a null vec_id. Vectors of different
lengths don't link. Repeated rows are vectors of their own; a repeated vec_id shares its
component's smallest id. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import classed, components, local_roots, materialize, named_roots, table, tidy

THRESHOLD, TILE, BLOCK, LEAD, SAMPLE, RANGES = 0.9, 4096, 1024, 16, 4096, 16
_NEAR = 1e-9


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # else squares may overflow or vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _basis(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling share of the vectors' length."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def _forest(link: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links u[i] - v[j] connect."""
    r, c = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    sub = link[np.ix_(r, c)]
    if sub.sum() <= 8 * (len(r) + len(c)):
        i, j = np.nonzero(sub)
        return local_roots(u[r[i]], v[c[j]])
    far = np.iinfo(np.int64).max
    a, b = u[r].copy(), v[c].copy()
    while True:  # labels spread over the block until they are still
        a2 = np.minimum(a, np.where(sub, b[None, :], far).min(1))
        b2 = np.minimum(b, np.where(sub, a2[:, None], far).min(0))
        if np.array_equal(a, a2) and np.array_equal(b, b2):
            break
        a, b = a2, b2
    return local_roots(np.concatenate([u[r], v[c]]), np.concatenate([a, b]))


def compare(a: dict, b: dict | None, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, list]:
    """Linked vectors of each class of tile a, of tile b (None: a with itself), and forests.
    A tile has ids, n (copies) and raw vectors in double precision."""
    same, b = b is None, b or a
    one = {id(t): _unit(t["raw"]) @ basis for t in (a, b)}
    xa, xb = one[id(a)], one[id(b)]
    lead = min(LEAD, xa.shape[1])
    ra, rb = (np.sqrt((x[:, lead:] ** 2).sum(1)) for x in (xa, xb))
    na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    edges: list = []
    gap = np.maximum(0, np.maximum(xa[:, :lead].min(0) - xb[:, :lead].max(0), xb[:, :lead].min(0) - xa[:, :lead].max(0)))
    if (gap**2).sum() > 2 - 2 * threshold + _NEAR:
        return na, nb, None, edges
    room = [np.empty(BLOCK * BLOCK) for _ in range(2)]  # one pair of buffers for all blocks
    for i in range(0, len(xa), BLOCK):
        for j in range(i if same else 0, len(xb), BLOCK):
            p, q = xa[i : i + BLOCK], xb[j : j + BLOCK]
            part, can = (x[: len(p) * len(q)].reshape(len(p), len(q)) for x in room)
            np.matmul(p[:, :lead], q[:, :lead].T, out=part)
            np.multiply(ra[i : i + BLOCK, None], rb[None, j : j + BLOCK], out=can)
            np.add(part, can, out=can)
            can = can >= threshold - _NEAR
            r, c = np.flatnonzero(can.any(1)), np.flatnonzero(can.any(0))
            if not len(r):
                continue
            full = part[np.ix_(r, c)] + p[r, lead:] @ q[c, lead:].T
            link = full >= threshold
            for k, m in zip(*np.nonzero(np.abs(full - threshold) < _NEAR)):
                s, t = a["raw"][i + r[k]], b["raw"][j + c[m]]
                link[k, m] = float(s @ t) / (float(np.sqrt(s @ s)) * float(np.sqrt(t @ t))) >= threshold
            if same and i == j:
                link &= r[:, None] < c[None, :]
            if link.any():
                na[i + r] += link @ b["n"][j + c]
                nb[j + c] += a["n"][i + r] @ link
                edges.append(_forest(link, a["ids"][i + r], b["ids"][j + c]))
                if sum(len(e[0]) for e in edges) > 1 << 20:
                    edges = [local_roots(*(np.concatenate(x) for x in zip(*edges)))]
    return na, nb, None, edges


def _fit(classes: DataFrame, dims: dict[int, int], sample: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Basis of each vector length and inner bounds of its ranges, from a sample by hash."""
    basis, bounds = {}, {}
    for dim, n in dims.items():
        share = min(1.0, sample / n)
        got = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("embedding")
        v = np.array([r[0] for r in got.collect()], float).reshape(-1, dim)
        basis[dim] = _basis(_unit(v)) if len(v) else np.eye(dim)
        cut = max(1, min(RANGES, n // TILE))
        bounds[dim] = np.quantile(_unit(v) @ basis[dim][:, 0], np.arange(1, cut) / cut) if len(v) and cut > 1 else np.zeros(0)
    return basis, bounds


def link_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """From classes (node, embedding, n) of distinct valid vectors: rows (u, null, links) with
    numbers of linked vectors to be added up, and rows (u, v, null) with links."""
    spark = classes.sparkSession
    classes = classes.withColumn("dim", F.size("embedding"))
    dims = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    basis, bounds = _fit(classes, dims, SAMPLE)

    def ranged(batches):
        for b in batches:
            flat = [np.array(x.as_py(), float) for x in b.column(1)]
            r = [int(np.searchsorted(bounds[len(x)], float(_unit(x[None])[0] @ basis[len(x)][:, 0]), "right")) for x in flat]
            vec = pa.array([x.tobytes() for x in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(r, pa.int32()), b.column(0), b.column(2), vec], names=["dim", "range", "node", "n", "vec"])

    rows = materialize(classes.select("node", "embedding", "n", "dim").mapInArrow(ranged, "dim int, range int, node bigint, n bigint, vec binary"), "vectors")
    # How many tiles a range has, and a number for every tile.
    tiles, first = {}, 0
    for r in sorted(rows.groupBy("dim", "range").agg(F.count("*").alias("n")).collect()):
        tiles[r["dim"], r["range"]] = (first, -(-r["n"] // TILE))
        first += tiles[r["dim"], r["range"]][1]
    if not tiles:
        return spark.createDataFrame([], "u bigint, v bigint, links bigint")
    known = spark.createDataFrame([(d, r, f, k) for (d, r), (f, k) in tiles.items()], "dim int, range int, first int, parts int")
    tile = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int").alias("tile")
    dealt = rows.join(F.broadcast(known), ["dim", "range"]).select(tile, "dim", "range", "node", "n", "vec")

    def pack(t: pa.Table) -> pa.Table:
        ids, n = (np.array(t[c].to_numpy(), np.int64) for c in ("node", "n"))
        return pa.table({"tile": t["tile"][:1], "dim": t["dim"][:1], "range": t["range"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "vec": pa.array([b"".join(t["vec"].to_pylist())], pa.binary())})

    packed = dealt.groupBy("tile").applyInArrow(pack, "tile int, dim int, range int, ids binary, n binary, vec binary")
    # Ranges that can hold linked vectors: at most RANGES for each range.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _NEAR
    mates = []
    for d, r in tiles:
        lo = bounds[d][r - 1] if r else -np.inf
        hi = bounds[d][r] if r < len(bounds[d]) else np.inf
        for d2, r2 in tiles:
            lo2 = bounds[d][r2 - 1] if r2 else -np.inf
            hi2 = bounds[d][r2] if r2 < len(bounds[d]) else np.inf
            if d == d2 and max(lo, lo2) - min(hi, hi2) <= reach:
                f, k = tiles[d2, r2]
                mates.append((d, r, f, f + k - 1))
    mates = spark.createDataFrame(mates, "dim int, range int, low int, high int")
    pairs = packed.join(F.broadcast(mates), ["dim", "range"]).withColumn("mate", F.explode(F.sequence("low", "high")))
    pairs = pairs.select(F.least("tile", "mate").alias("i"), F.greatest("tile", "mate").alias("j"), "tile", "dim", "ids", "n", "vec")

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        both = [
            {"ids": np.frombuffer(i, np.int64), "n": np.frombuffer(n, np.int64), "raw": np.frombuffer(v, float).reshape(-1, dim)}
            for _, i, n, v in sorted(zip(t["tile"].to_pylist(), t["ids"].to_pylist(), t["n"].to_pylist(), t["vec"].to_pylist()), key=lambda x: x[0])
        ]
        na, nb, _, edges = compare(both[0], both[1] if len(both) > 1 else None, basis[dim], threshold)
        u = [both[0]["ids"][na > 0], both[-1]["ids"][nb > 0]]
        n = [na[na > 0], nb[nb > 0]]
        nodes, root = local_roots(*(np.concatenate(x) for x in zip(*edges))) if edges else (np.zeros(0, np.int64),) * 2
        nodes, root = nodes[nodes != root], root[nodes != root]
        tidy()
        k = sum(map(len, u))
        none = pa.nulls
        return pa.table(
            {
                "u": pa.array(np.concatenate([*u, nodes])),
                "v": pa.concat_arrays([none(k, pa.int64()), pa.array(root, pa.int64())]),
                "links": pa.concat_arrays([pa.array(np.concatenate(n), pa.int64()), none(len(root), pa.int64())]),
            }
        )

    return pairs.groupBy("i", "j").applyInArrow(run, "u bigint, v bigint, links bigint")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(ok & F.col("vec_id").isNotNull(), F.lit(False))
    valid = v.where(ok)
    classes = valid.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "vec_id", "embedding", "n"), "classes")
    found = materialize(link_classes(classes.select("node", "embedding", "n"), threshold), "links")
    links = found.where("v IS NULL").groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(found.where("v IS NOT NULL").select("u", "v"))
    low = named_roots(classes.select("node", "vec_id"), roots, "vec_id", "roots").withColumnRenamed("node", "_n")
    named = (
        classes.join(links, F.col("node") == F.col("u"), "left")
        .join(low, F.col("node") == F.col("_n"), "left")
        .select("embedding", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    )
    linked = classed(valid, named, "embedding", "vector-classes").select("vec_id", "n_links", "component_id")
    alone = v.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))
