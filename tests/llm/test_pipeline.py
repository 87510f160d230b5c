"""The pipeline's stages, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from ranksmith.llm import pii

from .test_queries import groups


def test_stages(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = {i: t for i, t, *_ in rows}
    one = cp.language(spark, docs, sf_dir)
    assert one.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in one.collect()))) == sorted(str(i) for i, t, *_ in rows if t and any(c.isalpha() for c in t))

    told = {r["doc_id"]: r["lang"] for r in one.collect()}
    assert all(told[i] == lang for i, t, lang, *_ in rows if lang and t and len(t) > 80 and i != 231)
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    told = {r["doc_id"]: r["lang"] for r in cp.language(spark, hidden, sf_dir).collect()}
    assert all(told[i] == lang for i, t, lang, *_ in rows if lang and t and len(t) > 80 and i != 231)

    two = cp.near_duplicates(spark, docs, sf_dir)
    assert two.columns == docs.columns
    kept = [r["doc_id"] for r in two.collect()]
    assert len(kept) == len(set(kept))

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""}

    s = [shingles(t) for _, t, *_ in rows]
    near = {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for i in range(len(s)) for j in range(i)}
    g = groups(len(rows), [p for p, x in near.items() if x >= 0.8])
    for group in set(g):  # of similar texts only the one with the smallest id stays
        ids = [r[0] for r, x in zip(rows, g) if x == group and r[0] is not None]
        assert sorted(set(ids) & set(kept)) == ([min(ids)] if ids else [])
    apart = [i for i in range(len(s)) if all(x < 0.5 for p, x in near.items() if i in p)]
    assert {rows[i][0] for i in apart} <= set(kept)

    three = cp.decontaminate(spark, docs, sf_dir)
    item = rows[10][1][20:220].strip()
    assert sorted(map(str, (r["doc_id"] for r in three.collect()))) == sorted(str(i) for i, t, *_ in rows if not (t and item in t))

    four = cp.personal_data(spark, docs, sf_dir).collect()
    assert len(four) == len(rows)
    for r in four:
        t = by[r["doc_id"]]
        assert r["text"] == (None if t is None else pii.redacted(t, pii.scan(t))) and r["n_chars"] == (None if t is None else len(r["text"]))

    five = cp.mix(spark, docs, sf_dir).collect()
    assert all(1 <= r["copies"] <= 3 for r in five)


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "copies"} <= set(out.columns)
    assert out.count() > 20
    assert not any("@mail.example.com" in r["text"] for r in out.select("text").collect())


def test_language_without_labels(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = cp.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(i) for i, t, *_ in rows if t and any(c.isalpha() for c in t))
