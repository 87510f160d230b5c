"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language tells, at any place of a text, how far the
text goes on as something seen in that language. Cross-parsing cuts the text greedily into
such longest matches. Phrases grow with the logarithm of the labelled text they are looked up
in, so a language's entropy is its phrases a symbol times the logarithm of the size of its
labelled text: the language of the least entropy wins, however much of each was to be had.

Fitting takes a bounded sample (parameters PIECES and PIECE_CHARS: pieces of at most
PIECE_CHARS characters at hash-chosen places of about PIECES hash-chosen distinct texts a
language, and of these SAMPLE_BYTES bytes, but at most TOTAL_BYTES for all languages; the LANGUAGES
labels with most texts); only this sample comes to the driver, and it bounds what a worker
holds: two states a byte, a row of next states each, over a language's own symbols. Prediction
reads every text whole: all texts of a batch are cut in segments of SEGMENT symbols and all
segments are parsed in lockstep, one table lookup a symbol and language, so a very long text
is many lanes, not one slow row. A segment's end ends a phrase, alike for every language.

Symbols are the bytes of the lower-cased text; ASCII other than letters counts as a space and
runs of spaces as one. A text that is null or has no letter is `und` with score 0. Ties go to
the language first by code point. Rows without label or text are not learnt from; with no
labelled row all are `und`. Repeated rows are each predicted. Extra columns are ignored by
predict and kept by label_known, which gives every row that it keeps the language predicted
(its own label where there was nothing to learn from) and drops only null and letterless texts.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

PIECES, PIECE_CHARS, SAMPLE_BYTES = 48, 4096, 48 << 10
TOTAL_BYTES, LANGUAGES = 1 << 20, 512
SEGMENT, LANES = 1024, 6144
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def symbols(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Labelled sample text of each language from docs (text, lang)."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    distinct = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    n = {r["lang"]: r["n"] for r in distinct.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not n:
        return {}
    most = min(SAMPLE_BYTES, TOTAL_BYTES // len(n))
    # A text is in the sample if its hash is under its language's share of the hash range.
    mark = F.create_map(*(x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * PIECES / v)))))
    part = F.pmod(F.col("h"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    room = F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1
    at = (F.pmod(F.xxhash64("h"), room) + 1).cast("int")
    piece = F.substring(F.col("text"), at, F.lit(PIECE_CHARS))
    got = labelled.where(part < mark[F.col("lang")]).select("lang", "h", piece.alias("piece")).distinct()
    out: dict[str, bytes] = {}
    for r in sorted(got.collect(), key=lambda r: (r["lang"], r["h"])):
        have = out.get(r["lang"], b"")
        if len(have) < most:
            out[r["lang"]] = have + b" " * bool(have) + symbols(r["piece"])
    return {k: out[k][:most] for k in sorted(out) if out[k]}


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start. Every substring of text is a path."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class CrossParser:
    """An automaton a language as a flat table of next states (multiplied by the size of the
    language's alphabet). Where a match can't go on, the table has the bitwise complement of the
    state in which the next phrase starts."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        #: What a phrase of each language costs.
        self.cost = np.log2([len(samples[k]) + 2 for k in self.langs])
        self.classes, self.tables = [], []
        for lang in self.langs:
            seen = sorted(set(samples[lang]))
            cls, width = np.zeros(256, np.int32), len(seen) + 1  # class 0: bytes not in the sample
            cls[seen] = np.arange(1, width)
            states = suffix_automaton(samples[lang])
            row = np.repeat(np.arange(len(states)), [len(s) for s in states])
            col = cls[np.fromiter((c for s in states for c in s), np.uint8, len(row))]
            to = np.fromiter((x for s in states for x in s.values()), np.int32, len(row))
            goto = np.full((len(states), width), -1, np.int32)
            goto[row, col] = to * width
            start = np.maximum(goto[0], 0)
            self.classes.append(cls)
            self.tables.append(np.where(goto >= 0, goto, ~start[None, :]).ravel())

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum(sizes) - sizes
        per = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(texts)), per)
        k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        starts = first[of] + k * SEGMENT
        lens = np.minimum(SEGMENT, sizes[of] - k * SEGMENT)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for a in range(0, len(of), LANES):
            order = a + np.argsort(-lens[a : a + LANES], kind="stable")
            n, at = lens[order], starts[order]
            left = np.searchsorted(-n, -np.arange(1, SEGMENT + 1), "right")  # lanes longer than j
            for i, (cls, table) in enumerate(zip(self.classes, self.tables)):
                state = np.zeros(len(order), np.int32)
                count = np.ones(len(order), np.int32)
                for j in range(int(n[0])):
                    m = int(left[j])
                    got = table[state[:m] + cls[buf[at[:m] + j]]]
                    failed = got >> 31
                    count[:m] -= failed
                    state[:m] = got ^ failed
                np.add.at(out[:, i], of[order], count)
        return out


def _parser(samples: dict[str, bytes]) -> CrossParser:
    """One parser a worker process, kept for its later tasks."""
    kept = sys.__dict__.setdefault("_ranksmith_langid", {})
    key = hash(tuple(samples.items()))
    if key not in kept:
        kept.clear()
        kept[key] = CrossParser(samples)
    return kept[key]


def classify(texts: list[str | None], samples: dict[str, bytes]) -> tuple[list[str], np.ndarray]:
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and samples and _LETTER.search(t)]
    if known:
        parser = _parser(samples)
        a = 0
        while a < len(known):  # groups of bounded size
            b, size, group = a, 0, []
            while b < len(known) and size < 4 << 20:
                group.append(symbols(texts[known[b]]))
                size += len(group[-1])
                b += 1
            n = parser.phrases(group) * parser.cost
            best = n.argmin(1)
            two = np.sort(n, 1)[:, :2]
            margin = 1 - two[:, 0] / np.maximum(two[:, 1], 1.0) if n.shape[1] > 1 else np.ones(len(group))
            for i, j in enumerate(known[a:b]):
                lang[j] = parser.langs[best[i]]
                score[j] = margin[i] if len(group[i]) else 0.0
            a = b
    return lang, score


def predict(docs: DataFrame, samples: dict[str, bytes], keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """docs' kept columns with lang_pred and score."""

    def run(batches):
        for b in batches:
            lang, score = classify(b.column(b.num_columns - 1).to_pylist(), samples)
            tidy()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def label_known(docs: DataFrame, samples: dict[str, bytes], lang_col: str = "lang") -> DataFrame:
    """docs without those whose language can't be told (null, or no letter), with lang_col, where
    docs has one, the language predicted. With no samples labels stay and that rule decides."""

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            i = b.schema.get_field_index(lang_col)
            if samples:
                lang = classify(texts, samples)[0]
                keep = [x != "und" for x in lang]
                if i >= 0:
                    b = b.set_column(i, b.schema.field(i), pa.array(lang, b.schema.field(i).type))
            else:
                keep = [bool(t and _LETTER.search(t)) for t in texts]
            tidy()
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 3 is not 1 (a null id: never)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True)))
    return predict(docs, fit(docs.where("not held_out").select("text", "lang")))
