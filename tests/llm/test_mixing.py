import random
import re

from tidewatch.llm import mixing


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}", 1) for i in range(n)]
    rows += [(n, None, "s0", 1), (n + 1, "a b", None, 1), (n + 1, "a b", None, 1), (None, "x   y", "empty", 1), (n + 2, "", "none", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rid int"), rows


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        level = left / max(1e-9, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in names if s not in full}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        full |= over


def test_targets_and_words_taken(spark):
    docs, rows = table(spark)
    out = mixing.mixed(docs, block=64).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mixed(docs.repartition(7), block=64).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_schedule_keeps_the_shares_all_along(spark):
    sources = spark.createDataFrame([("a", 100_000, 60_000.0), ("b", 50_000, 80_000.0), (None, 30, 60.0)], "source string, source_size long, target double")
    slots = sorted(mixing.schedule(sources, 100).collect(), key=lambda r: r.slot)
    words = {}
    for k, r in enumerate(slots, 1):
        words[r.source] = words.get(r.source, 0) + r["last"] - r["first"]
        if k > 50 and r.source:
            assert abs(words["a"] / 60_000 - words.get("b", 0) / 80_000) < 0.05
    assert words == {"a": 60_000, "b": 80_000, None: 60}


def test_documents_of_the_mix(spark):
    docs, rows = table(spark)
    out = mixing.mix_documents(docs, block=64)
    assert out.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect())
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    assert abs(words / total - 1.5) < 0.1
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_the_schedule_decides_the_order(spark, monkeypatch):
    docs, rows = table(spark)
    slots = lambda: {(r.doc_id, r["size"]): (r.taken, r.first_slot) for r in mixing.mixed(docs, block=64).collect()}
    golden = slots()
    order = [r.doc_id for r in mixing.mix_documents(docs, block=64).collect()]
    at = {i: s for (i, _), (t, s) in golden.items() if i is not None and i < 400}
    first = [at[i] for k, i in enumerate(order) if at.get(i) is not None and i not in order[:k]]
    assert len(first) > 200 and sum(a <= b for a, b in zip(first, first[1:], strict=False)) > 0.8 * len(first)
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    plain = slots()
    assert {k: t for k, (t, _) in golden.items()} == {k: t for k, (t, _) in plain.items()}
    assert sum(golden[k][1] != plain[k][1] for k in golden) > 100


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 100_000, "a"), (2, "v", "a"), (3, "", "b")], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    assert out[1]["size"] == 100_000 and out[3].taken == 0 and out[3].first_slot is None and sum(r.taken for r in out.values()) == 150_002
