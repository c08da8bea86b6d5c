import random
from collections import defaultdict

import pytest

from tidewatch.llm import links, ngram


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=3, similar=90):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows) if d is not None)


def corpus(seed=1, groups=12, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    texts = ["", None, " \t\n", "One", "one", "one two", "ONE  two", "one two three", "é É", "É É", "a b c d"] * 2
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 100, 400, 900]))]
        if rng.random() < 0.4:
            base = passage + base[:60]
        for _ in range(copies):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(1 + len(w) // 9)]
            texts.append(rng.choice([" ", "\n", " \x0b"]).join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("stars", "block"), [(2, 1024), (0, 4)])
def test_groups_against_brute_force(spark, monkeypatch, stars, block):
    monkeypatch.setattr(ngram, "STARS", stars)
    monkeypatch.setattr(ngram, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, n int, print string")
    want = brute(rows)
    out = ngram.near_groups(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    if stars:
        return
    out = ngram.near_groups(docs, count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    sets = {frozenset(shingle_set(t, 3)) for _, t in rows if shingle_set(t, 3)}
    text = dict(rows)
    for r in out:
        own = shingle_set(text[r.doc_id], 3)
        assert r.n_links == sum(own != s and 100 * len(own & s) >= 90 * len(own | s) for s in sets if own)


def test_repeated_rows_null_ids_long_texts_and_empty(spark):
    long = " ".join(f"t{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (1, long), (2, long + " end"), (None, "a B c d"), (None, "")]
    out = ngram.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (1, 29_998, 1), (2, 29_999, 1)]
    assert ngram.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rng = random.Random(4)
    kept = ngram.Hashes()
    for _ in range(50):
        a = [b"%d" % rng.randrange(60) for _ in range(rng.randrange(3, 200))]
        b = a[:]
        b[rng.randrange(len(b))] = b"new"
        x, y = ngram.shingles(a, kept, 3), ngram.shingles(b, kept, 3)
        away = len(set(x.tolist()) ^ set(y.tolist()))
        bits = ngram.parities(x) ^ ngram.parities(y)
        assert sum(int(v).bit_count() for v in bits.view("uint64")) <= away
        assert (ngram.sketch(x, 7) != ngram.sketch(y, 7)).sum() <= away


def test_components_of_long_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (250, 300), (250, 250)]
    out = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(60)) and out[300] == out[250] == 200


def test_filter_keeps_one_of_each_group(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK", 4)
    rows = corpus(seed=3)
    docs = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, print string")
    kept = ngram.drop_near_copies(docs, size=3, similar=90)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in brute(rows) if d == c)
    again = ngram.drop_near_copies(docs.unionAll(docs.where("text RLIKE '[^ \\t\\n]'")), size=3, similar=90)
    assert sorted(r.doc_id for r in again.collect()) == sorted(d for d, n, c in brute(rows) if d == c)
    assert ngram.drop_near_copies(docs.limit(0)).count() == 0


def test_many_short_sets_of_few_parts(spark):
    rng = random.Random(11)
    texts = []
    for g in range(150):
        base = [f"g{g}x{i}" for i in range(rng.randrange(8, 40))]
        texts += [" ".join(base[: len(base) - cut] + [f"e{g}y{i}" for i in range(more)]) for cut, more in ((0, 0), (0, 1), (1, 0), (0, 2), (1, 1))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t, 5) for t in texts]
    near = lambda x, y: x != y and 100 * len(x & y) >= 80 * len(x | y)
    group = lambda i: range(i - i % 5, i - i % 5 + 5)  # words of a group are its own

    _, nodes, _ = ngram.sets_of(docs, "doc_id", "text", 5, 80)
    doc = {r.node: r.doc_id for r in nodes.collect()}
    shared = ngram.shared_parts(nodes)
    _, bounds = ngram.slimmed(nodes)
    found = {tuple(sorted((doc[r.a], doc[r.b]))) for r in ngram.candidates(shared, bounds, 80, every=True).collect()}
    want = {(j, i) for i in doc.values() for j in group(i) if j < i and j in doc.values() and near(sets[i], sets[j])}
    assert len(want) > 500 and not want - found

    out = ngram.near_groups(docs, size=5, similar=80, count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 5, 80)
    assert all(r.n_links == len({frozenset(sets[j]) for j in group(r.doc_id) if near(sets[r.doc_id], sets[j])}) for r in out)


def test_large_groups_of_near_copies(spark):
    """Copies of one text that are near it but not near each other, and a chain of such groups: no pairs are listed."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join(base)]
    for k in range(700):
        w = base[:]
        for at in rng.sample(range(0, 300, 4), 4):
            w[at] = f"c{k}x{at}"
        texts.append(" ".join(w))
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    out = ngram.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(3 * i + 1, 298, 1) for i in range(len(texts))]


def test_common_passages_bring_no_pairs_together(spark, monkeypatch):
    """Long texts with a common passage, which parity bits cannot tell apart; near copies among them are all found, in passes."""
    monkeypatch.setattr(ngram, "PASSES", 2)
    monkeypatch.setattr(ngram, "LEAST", 1500)
    monkeypatch.setattr(ngram, "SHARE", 1 << 40)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(30):
        own = [f"k{k}x{i}" for i in range(2500)]
        texts.append(" ".join(own[:1000] + passage + own[1000:]))
        if k < 6:
            for at in rng.sample(range(1000), 25):
                own[at] = f"e{k}x{at}"
            texts.append(" ".join(own[:1000] + passage + own[1000:]))
    _, nodes, _ = ngram.sets_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5, 80)
    doc = {r.node: r.doc_id for r in nodes.select("node", "doc_id").collect()}
    shared = ngram.shared_parts(nodes)
    _, bounds = ngram.slimmed(nodes)
    found = {tuple(sorted((doc[r.a], doc[r.b]))) for r in ngram.candidates(shared, bounds, 80, every=True).collect()}
    assert found >= {(2 * k, 2 * k + 1) for k in range(6)} and len(found) <= 12
