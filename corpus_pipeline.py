"""A training-corpus pipeline: five stages, each one of the operators of ranksmith.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet in the shared folder and rereads it as the next one's docs. All but the last
return the columns of documents. Empty tables pass through; nulls are defined in each operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ranksmith.llm import decontam, langid, mixing, pii, simhash
from ranksmith.llm.common import bounded_batches, materialize, table


def language(spark, docs, sf_dir):
    """Documents whose language can't be told (null, or without a letter) go. All others stay, with
    the predicted language as their lang: the classifier is fitted on the labelled rows of docs and
    reads texts only. Where no row is labelled there is nothing to predict, and labels stay null."""
    bounded_batches(spark)
    return langid.label_known(docs, langid.fit(docs.select("text", "lang")))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays, that of the smallest doc_id."""
    bounded_batches(spark)
    return simhash.keep_representatives(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item within its edit budget go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data is replaced by tags; n_chars follows the text. No document goes."""
    bounded_batches(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark, docs, sf_dir):
    """Documents the mix takes, with `copies` (1 to 3), `size`, `source_size` and `target`."""
    return mixing.mix_rows(docs).where("copies > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: Suffix automata, fingerprints over edit distances and the parsers have no SQL form; the
#: stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
