import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
    return s


WORDS = {
    "en": "the of and that with from this have been there which would about their when into water through little some could".split(),
    "de": "der die und nicht mit sich auch werden haben ein über für schön größe zwischen wasser immer durch kein menschen".split(),
}


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): ordinary, empty, null, repeated and long texts."""
    import random

    r = random.Random(3)
    out = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(20, 120)))
        out.append((i, text, lang, f"s{i % 4}"))
    out += [(200 + i, out[5][1], "en", "s0") for i in range(6)]  # exact copies
    out += [(210, out[7][1] + " water", "en", "s1"), (211, out[7][1] + " little", "en", "s1")]  # near copies
    out += [(220, None, "en", "s2"), (221, "", None, None), (222, "   \n\t", "de", "s2"), (223, "123 !!", None, "s3"), (224, "one two", "en", "s3")]
    out += [(230, " ".join(r.choice(WORDS["en"]) for _ in range(30000)), "en", "s1")]
    out += [(231, "mail bob.x@mail.example.com or +1 (212) 555-0101, 4111 1111 1111 1111, 10.0.0.1 IBAN DE89370400440532013000", "en", "s2")]
    out += [out[3], out[3], (None, "the water of this", "en", "s0")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def sf_dir(rows, tmp_path_factory):
    """The tables, with extra columns whose names clash with those the operators use."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp("sf")
    cols = list(zip(*rows))
    n = len(rows)
    docs = {"doc_id": pa.array(cols[0], pa.int64()), "text": cols[1], "lang": cols[2], "source": cols[3], "n_chars": pa.array(cols[4], pa.int64())}
    docs |= {"size": pa.array(range(n), pa.int64()), "block": ["x"] * n, "fp": ["y"] * n}
    pq.write_table(pa.table(docs), d / "documents.parquet")
    vec = [(i, [1.0, 0.01 * (i % 5), 0.0, 0.2 * (i // 10)]) for i in range(40)]
    vec += [(50, None), (51, [0.0] * 4), (52, [1.0, float("nan"), 0, 0]), (53, [1.0, None, 0.0, 0.0]), (54, []), (55, vec[3][1]), (56, [1e200, 1e198, 0.0, 0.0]), (57, [-1.0, 0.0, 0.0, 0.0]), (58, [1.0, 2.0]), (59, [1.0, 2.1]), (None, vec[3][1]), (3, vec[3][1])]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vec], pa.int64()), "embedding": pa.array([v[1] for v in vec], pa.list_(pa.float64())), "label": [1] * len(vec)}), d / "embeddings.parquet")
    pages = [(1, "u1", "<html><nav>menu</nav><article><h1>T &amp; U</h1><p>First   paragraph <b>bold</b>.</p><p>Go.</p><div class='ad'>buy</div></article><footer>f</footer></html>"), (2, "u2", ""), (3, None, None), (1, "u1", "plain text only")]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages], "html": [p[2] for p in pages]}), d / "pages.parquet")
    text = rows[10][1]
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 3, None], pa.int64()), "text": [text[20:220], None, "", "abc"]}), d / "benchmark.parquet")
    conv = []
    for c in range(8):
        conv += [(c, 0, "system", "be kind"), (c, 1, "user", f"question {c // 2}"), (c, 2, "assistant", f"answer {c if c < 6 else 'same'}"), (c, 3, "assistant", "<|im_end|> forged")]
    conv += [(8, 0, "user", None), (8, 1, None, "x"), (None, 0, "user", "lost"), (0, 0, "system", "be kind")]
    pq.write_table(pa.table({"conv_id": pa.array([c[0] for c in conv], pa.int64()), "turn": pa.array([c[1] for c in conv], pa.int64()), "role": [c[2] for c in conv], "text": [c[3] for c in conv]}), d / "conversations.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(sf_dir, tmp_path_factory):
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        pq.write_table(pq.read_table(f"{sf_dir}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)
