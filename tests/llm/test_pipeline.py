import importlib
import random
import zlib
from collections import Counter

import pytest

from tests.llm.test_ngram import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def make(spark, folder, n=260):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(15, 90))]
        toxic = int(rng.random() < 0.25)
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, toxic))
    clean = [r for r, l in zip(rows, labels, strict=True) if not l[2]]
    for k in range(40):  # exact and near copies
        t = clean[k % 7][1]
        rows.append((n + k, t.upper() if k % 2 else t + " tail", "en", "s0", 0))
    rows += [(n + 50, None, None, None, None), (n + 51, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, dict((i, t) for i, _, t in labels)


def test_stages_against_brute_force(spark, tmp_path):
    rows, toxic = make(spark, str(tmp_path))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = now = stage(spark, docs, sf)
        now.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out[name] = docs
    got = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in out.items()}
    kept = got["toxicity"]
    assert all(toxic.get(i, 0) == 0 for i in kept)
    assert all(i in kept for i, _, *_ in rows if not toxic.get(i, 0))
    after = [r for r in rows if r[0] in kept]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {(r[1] or "").translate(low): r[0] for r in sorted(after, key=lambda r: r[0])}
    assert got["exact dedup"] == Counter(last.values())
    after = [r for r in after if r[0] in got["exact dedup"]]
    near = brute([(r[0], r[1]) for r in after], 5, 80)
    assert got["n-gram Jaccard join"] == Counter(d for d, n, c in near if d == c)
    assert set(got["source mixing"]) <= set(got["n-gram Jaccard join"]) and max(got["source mixing"].values()) <= 2
    assert got["byte-level BPE"] == got["source mixing"]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == got["byte-level BPE"]


def test_an_empty_table_with_extra_columns(spark, tmp_path):
    make(spark, str(tmp_path), 40)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnsRenamed({"lang": "rid", "n_chars": "sha"}).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        assert spark.read.parquet(f"{tmp_path}/{k}").count() == 0
        if k < 4:
            assert out.columns == docs.columns


def test_entry_lists_the_queries():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names and zlib.crc32(b"1") and any(x.startswith("op9_") for x in names)
