"""Preference formatting, in DataFrame functions only.

Two conversations of a pair, one chosen and one rejected, share a longest common prefix of
turns (equal role and text). It is rendered once as the prompt; the turns after it are the two
completions, each with a mask: the character spans `start:end` (end exclusive, comma-joined,
counted in the completion) of the assistants' texts and their end marks, on which a loss is
taken. A turn is rendered as <|im_start|>role\\ntext<|im_end|>\\n, and `<|im_` inside a text or
role as `<|_im_`, so that no text can forge a mark.

Turns go by turn, then role, then text, nulls first; repeated turns are turns. A null role is
rendered as `unknown`, a null text as empty. A pair that lacks one side has an empty prompt
and that side empty; equal conversations are all prompt. Rows without pair_id or side (of
reply_pairs: without conv_id) are left out. Extra columns are ignored. One shuffle brings a pair
together: a pair is one output row, so its two conversations must fit a row, and no group is
larger than that.

reply_pairs makes pairs of a table of plain conversations: each is chosen as it is, and rejected
with its last assistant turn replaced by that of another conversation. Replies are dealt in
buckets of the hash of conv_id, as many as keep a bucket at about BUCKET conversations whatever
their number: each conversation gets the reply of the next one in its bucket by hash, the last
one that of the first. A conversation without an assistant turn, or alone in its bucket, is all
prompt; so is the part before the last turn where two replies are equal, and all of it then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Conversations of a bucket in which replies are dealt: up to 16 times as few on average.
BUCKET = 4096


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|im_"), F.lit("<|_im_"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(START), _safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(_safe(F.coalesce(t["text"], F.lit(""))), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def format_pairs(turns: DataFrame) -> DataFrame:
    """From turns (pair_id, chosen boolean, turn, role, text): the columns of formatted()."""
    turn = F.struct("turn", "role", "text")
    t = turns.where("pair_id IS NOT NULL AND chosen IS NOT NULL").groupBy("pair_id")
    return formatted(t.agg(F.sort_array(F.collect_list(F.when(F.col("chosen"), turn))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("chosen"), turn))).alias("r")))


def formatted(t: DataFrame) -> DataFrame:
    """From pairs (pair_id, c, r: turns in order): pair_id, n_prompt, n_chosen, n_rejected (turns),
    prompt, chosen, chosen_mask, rejected, rejected_mask."""
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, False)
    t = t.withColumn("k", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda s: F.slice(s, F.col("k") + 1, F.size(s))
    t = t.withColumns({"p": F.slice("c", F.lit(1), F.col("k")), "c": rest("c"), "r": rest("r")})
    return t.select(
        "pair_id",
        F.size("p").cast("long").alias("n_prompt"),
        F.size("c").cast("long").alias("n_chosen"),
        F.size("r").cast("long").alias("n_rejected"),
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def reply_pairs(conversations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(pair_id, c, r) of conversations (conv_id, turn, role, text), one pair a conversation."""
    one = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("pair_id"))
    one = one.agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("c"))
    n = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct().count()
    digits = len(f"{n // bucket:x}") if n >= bucket else 0
    at = F.array_max(F.transform("c", lambda t, i: F.when(t["role"] == "assistant", i)))
    one = one.withColumn("at", at)
    h = F.md5(F.col("pair_id").cast("string"))
    reply = F.get(F.col("c"), F.col("at"))["text"]
    dealt = one.where("at IS NOT NULL").select(F.col("pair_id").alias("_id"), h.alias("_h"), F.struct(reply.alias("text")).alias("_own"))
    deal = Window.partitionBy(F.substring("_h", 1, digits)).orderBy("_h", "_id")
    everyone = deal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = dealt.select("_id", F.coalesce(F.lead("_own").over(deal), F.first("_own").over(everyone)).alias("_other"))
    one = one.join(dealt, F.col("pair_id") == F.col("_id"), "left")
    swapped = F.transform("c", lambda t, i: F.when(i == F.col("at"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("_other.text").alias("text"))).otherwise(t))
    return one.select("pair_id", "c", F.when(F.col("at").isNull(), F.col("c")).otherwise(swapped).alias("r"))


def op6_preference_format(spark, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its last reply dealt anew."""
    return formatted(reply_pairs(table(spark, sf_dir, "conversations")))


OP6_SQL = """
WITH q AS (
  SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT pair_id, max(i) FILTER (role = 'assistant') AS last FROM q GROUP BY pair_id),
z AS (SELECT count(*) AS n FROM u),
v AS (
  SELECT u.pair_id, u.last, md5(u.pair_id::VARCHAR) AS h, substr(md5(u.pair_id::VARCHAR), 1, CASE WHEN n >= 4096 THEN length(printf('%x', n // 4096)) ELSE 0 END) AS b, {'own': q.text} AS own
  FROM u JOIN q ON q.pair_id = u.pair_id AND q.i = u.last, z),
x AS (
  SELECT pair_id, last, coalesce(lead(own) OVER (PARTITION BY b ORDER BY h, pair_id), first(own) OVER (PARTITION BY b ORDER BY h, pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other
  FROM v),
y AS (
  SELECT pair_id, 0 AS side, i, role, text FROM q
  UNION ALL
  SELECT q.pair_id, 1, i, role, CASE WHEN i = x.last THEN struct_extract(x.other, 'own') ELSE text END FROM q LEFT JOIN x ON x.pair_id = q.pair_id),
t AS (
  SELECT *,
         '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '<|_im_') || chr(10) AS head,
         replace(coalesce(text, ''), '<|im_', '<|_im_') || '<|im_end|>' AS body
  FROM y),
n AS (SELECT pair_id, side, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT pair_id, max(CASE WHEN side = 0 THEN n ELSE 0 END) AS nc, max(CASE WHEN side = 1 THEN n ELSE 0 END) AS nr FROM n GROUP BY pair_id),
d AS (
  SELECT c.pair_id, min(c.i) AS i
  FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.i = r.i AND c.side = 0 AND r.side = 1
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id),
k AS (SELECT p.*, least(coalesce(d.i - 1, least(nc, nr)), least(nc, nr)) AS k FROM p LEFT JOIN d USING (pair_id)),
o AS (
  SELECT t.*, k.k, sum(length(head) + length(body) + 1) OVER (PARTITION BY t.pair_id, side, t.i > k.k ORDER BY t.i) - length(body) - 1 AS pos
  FROM t JOIN k USING (pair_id))
SELECT k.pair_id, any_value(k.k)::BIGINT AS n_prompt, any_value(nc - k.k)::BIGINT AS n_chosen, any_value(nr - k.k)::BIGINT AS n_rejected,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 0 AND i <= o.k), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 0 AND i > o.k), '') AS chosen,
  coalesce(string_agg(pos::BIGINT || ':' || (pos + length(body))::BIGINT, ',' ORDER BY i) FILTER (side = 0 AND i > o.k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 1 AND i > o.k), '') AS rejected,
  coalesce(string_agg(pos::BIGINT || ':' || (pos + length(body))::BIGINT, ',' ORDER BY i) FILTER (side = 1 AND i > o.k AND role = 'assistant'), '') AS rejected_mask
FROM k JOIN o USING (pair_id) GROUP BY k.pair_id
"""
