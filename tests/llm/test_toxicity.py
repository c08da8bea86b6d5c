import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from tidewatch.llm import toxicity as T


def brute_segments(scores):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""

    def go(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        s, _, _, i, j = best
        return [*go(a, i), (i, j, s), *go(j, b)]

    return go(0, len(scores))


def test_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 25)
        scores = [rng.choice([rng.uniform(0.05, 1.0), rng.uniform(-1, -0.05)]) for _ in range(n)]
        got, want = T.maximal_segments(np.array(scores)), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_rate_solves_the_equation():
    assert abs(T.rate_of(np.array([1.0, -1.0]), np.array([10.0, 90.0])) - math.log(9)) < 1e-6
    assert T.rate_of(np.zeros(0), np.zeros(0)) == 1.0


def test_tokens_of_scripts_without_spaces():
    assert T.tokens_of("A\u3001 \u6f22\u5b57\u8a9e b\u00a0c") == ["a".encode(), "\u6f22\u5b57".encode(), "\u5b57\u8a9e".encode(), b"b", b"c"]
    assert T.tokens_of("\u6f22") == ["\u6f22".encode()] and T.tokens_of(None) == []


def brute_scores(docs, labels):
    """The whole model in plain Python on words and strings, for documents of ASCII words."""
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    known = {i: t for i, t in labels if t is not None and zlib.crc32(str(i).encode()) % 5}
    texts = {i: split(t) for i, t, *_ in docs}
    seen = {(w, known[i], v) for i in known for v, w in zip([None, *texts[i]], texts[i])}
    counts = defaultdict(lambda: [0, 0])
    chain = lambda w: [w[:k] for k in (3, 4, 5, 6, 8) if len(w) > k] + [w + "$"]
    for w, t, _ in seen:
        for f in chain(w):
            counts[f][t] += 1
    share = (sum(t for _, t, _ in seen) + 1) / (len(seen) + 2)

    def score(w, own):
        m = share
        for f in chain(w):
            c, a = counts[f] if sum(counts[f]) > 1 else (0, 0)
            c, a = max(0, c - (own == 0)), max(0, a - (own == 1))
            m = (a + 30 * m) / (a + c + 30)
        return math.log(m / (1 - m)) - math.log(share / (1 - share)) - 1

    found = {i: [s for _, _, s in brute_segments([score(w, t) for w in texts[i]])] for i, t in known.items()}
    clean = [round(score(w, 0), 2) for i, t in known.items() if not t for w in texts[i]]
    low, high = 1e-6, 64.0
    for _ in range(100):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(math.exp(rate * s) for s in clean) < len(clean) else (low, rate)
    best = [(max(found[i], default=0), len(texts[i])) for i, t in known.items() if not t]
    k = len(best) / sum(n * math.exp(-rate * s) for s, n in best)
    excess = lambda f, n: sum(max(0, rate * s - math.log(k * max(n, 1))) for s in f)
    slope, offset = T.logistic(np.array([excess(found[i], len(texts[i])) for i in known]), np.array([float(t) for t in known.values()]), np.ones(len(known)))
    all_of = {i: excess([s for _, _, s in brute_segments([score(w, None) for w in texts[i]])], len(texts[i])) for i in texts}
    return {i: 1 / (1 + math.exp(-min(30, max(-30, offset + slope * x)))) for i, x in all_of.items()}


def test_scores_against_brute_force(spark):
    docs, labels = corpus(120, seed=4, toxic_words=44)
    docs = [(i, " ".join(t.split()[:30]), x) for i, t, x in docs]
    out = T.toxicity(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = brute_scores(docs, labels)
    assert len({round(x, 6) for x in want.values()}) >= 4
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in out)


def corpus(n=1500, seed=2, toxic_words=4):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["Vile!", "vilest", "rotten", "grubby,", *(f"gru{k}" for k in range(40))][:toxic_words])
        docs.append((i, " ".join(text), "x"))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "vile rotten vile", "x"), (9000, None, "x"), (9001, "", "x"), (9002, "rotten " * 20_000, "x"), (0, docs[0][1], "x")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    l = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    out = T.toxicity(d, l).collect()
    assert len(out) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in out}
    assert by[None].predicted == 1 and by[9002].predicted == 1 and by[9000].predicted == by[9001].predicted == 0
    assert by[9000].segments == [] and by[None].segments[0].first == 0 and by[None].segments[0].end == 3


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    l = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.toxicity(d, l).collect()] == [0]
    assert T.toxicity(d.limit(0), l).count() == 0


def test_filter_keeps_columns(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame([(1, "vile! vilest rotten", "a", 3), (2, "word1 word2", "b", 4), (3, None, None, None)], "doc_id long, text string, _text string, score int")
    m = T.fit(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = T.keep_clean(d, m)
    assert kept.columns == d.columns and sorted(tuple(r)[0] for r in kept.collect()) == [2, 3]
