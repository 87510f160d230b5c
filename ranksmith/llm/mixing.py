"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Sources share a budget by weight; a source's target stops at `most` times its size and the
excess goes to the others by weight (water-filling: with capped sources in order of
cap / weight, the level is the largest (budget - caps before) / (weights from here on)).

A document is taken floor(target / size) times, and once more if its hash is under the
source's threshold. Thresholds come from nested histograms: words are summed by source and
the first 12 bits of the hash, the bucket where the running sum crosses the source's rest is
the boundary bucket, and only its documents are summed again by the next 12 bits, and then by
the last 12. Nothing is sorted but histograms of at most 4,096 rows a source, and the rows are
only filtered. The hash is of the doc_id and the text, and of a number among rows that repeat
both within a source, so each of such rows is judged on its own and reruns agree: the numbers of
n like rows are 0 to n - 1, whichever gets which. They are counted within the files of the
measured table and offset by the files before, so like rows may be a third of all.

Defined results: a null text has size 0; sources go by code point with null last; a source
without words has target 0; a null doc_id counts as the text "null"; an empty table gives an
empty result; other columns are kept by mix_rows, one that is named like one of its own under
its name and `_input` (as often as it takes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import classed, materialize, table

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Hexadecimal digits of the hash used by each level of histograms.
DIGITS, LEVELS = 3, 3
#: Sources up to which their one row each is broadcast; beyond it, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """From (source, source_size): target and rest, the words beyond whole repeats. One row a
    source, so its windows are over as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_i", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(everything) * share - before) / after)
    s = s.withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    s = s.withColumn("whole", whole.cast("long"))
    return s.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def _thresholds(sized: DataFrame, goal: DataFrame, n: int) -> DataFrame:
    """(source, bound): rows whose hash prefix is under bound make up the source's rest."""
    done = goal.select("source", F.col("rest").alias("left"), F.lit("").alias("prefix"))
    for level in range(1, LEVELS + 1):
        rows = sized.withColumn("b", F.substring("h", 1, DIGITS * level)).withColumn("prefix", F.substring("h", 1, DIGITS * (level - 1)))
        rows = rows.join(_few(done.select(F.col("source").alias("s"), F.col("prefix").alias("p"), "left"), n), F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")))
        hist = rows.groupBy("source", "b", "left").agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("n").over(run))
        # The boundary is the first bucket that goes beyond what is left.
        over = hist.where("upto > left").groupBy("source").agg(F.min(F.struct("b", "upto", "n", "left")).alias("x"))
        done = over.select("source", F.col("x.b").alias("prefix"), (F.col("x.left") - (F.col("x.upto") - F.col("x.n"))).alias("left"), F.col("x.n").alias("n"))
    # The last boundary bucket goes in if that comes nearer to the target.
    last = F.when(F.col("n") - F.col("left") < F.col("left"), F.concat("prefix", F.lit("g"))).otherwise(F.col("prefix"))
    bound = done.select(F.col("source").alias("s"), last.alias("bound"))
    full = F.when(F.col("rest") > 0, F.lit("g")).otherwise(F.lit(""))  # no bucket crosses: all or nothing
    return goal.join(bound, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("bound", full).alias("bound"))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns of docs (doc_id, text, source, ...) with, under names of our own, the source,
    the size, the hash and the copy number: texts are measured once, into a table."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    own = [F.col("source").alias("source"), size.alias("size"), key.alias("key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")]
    kept = F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row")
    all_ = materialize(docs.select(kept, *own), "measured")
    twins = all_.groupBy("key", "source").agg(F.count("*").alias("n")).where("n > 1")
    # A source is part of the key: its hash tells null from any text.
    of = F.xxhash64("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    like = classed(all_.select(of.alias("k"), "part", "rid"), twins.select(of.alias("k"), "n"), "k", "twins").select("k", "part", "rid")
    like = materialize(like, "like")
    n = like.count()
    per = like.groupBy("k", "part").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("k", "part", base.alias("base"))
    ordinal = F.row_number().over(Window.partitionBy("k", "part").orderBy("rid")) - 1
    numbered = like.withColumn("i", ordinal).join(per, ["k", "part"]).select(F.col("rid").alias("_r"), (F.col("base") + F.col("i")).alias("i")).where("i > 0")
    if n:
        all_ = all_.join(_few(numbered, n), F.col("rid") == F.col("_r"), "left")
    else:
        all_ = all_.withColumn("i", F.lit(0))
    h = F.md5(F.concat_ws(":", "key", F.coalesce("i", F.lit(0)).cast("string")))
    return all_.select("row", "source", "size", F.substring(h, 1, DIGITS * LEVELS).alias("h"))


def _free(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name += "_input"
    taken.add(name.lower())
    return name


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...), or keep's columns of it, with size, source_size, target
    and copies added."""
    keep = docs.columns if keep is None else keep
    rows = measured(docs, keep)
    sized = rows.select("source", "size", "h")
    goal = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share), "targets")
    n = goal.count()
    plan = _thresholds(sized, goal, n)
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "bound")
    out = rows.join(_few(plan, n), F.col("source").eqNullSafe(F.col("_s")))
    # Rows without words weigh nothing, so their hash may be under the bound of a source in full.
    copies = F.least(F.col("whole") + (F.col("h") < F.col("bound")).cast("long"), F.lit(most)).alias("copies")
    taken = {"size", "source_size", "target", "copies"}
    return out.select(*(F.col(f"row.`{c}`").alias(_free(c, taken)) for c in keep), "size", "source_size", "target", copies)


def op9_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix_rows(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same in DuckDB: the boundary is the first 36-bit bucket that goes beyond the rest.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) || ':' ||
                    (row_number() OVER (PARTITION BY doc_id, text, source) - 1)), 1, 9) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, ((i - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM g),
b AS (SELECT d.source, d.h, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM b),
x AS (SELECT c.source, min(c.h) AS h FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source WHERE c.upto > r.rest GROUP BY c.source),
y AS (
  SELECT r.*, x.h AS edge, c.n, r.rest - (c.upto - c.n) AS remain
  FROM r LEFT JOIN x ON x.source IS NOT DISTINCT FROM r.source
  LEFT JOIN c ON c.source IS NOT DISTINCT FROM r.source AND c.h = x.h),
z AS (SELECT *, CASE WHEN edge IS NULL THEN (CASE WHEN rest > 0 THEN 'g' ELSE '' END) WHEN n - remain < remain THEN edge || 'g' ELSE edge END AS bound FROM y)
SELECT d.doc_id, d.size, z.source_size, z.target, d.size * (z.whole + CASE WHEN d.h < z.bound THEN 1 ELSE 0 END) AS taken
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
"""
