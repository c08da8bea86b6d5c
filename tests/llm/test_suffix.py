import hashlib
import random

import numpy as np
import pytest

from tidewatch.llm import suffix


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), len(suffix.spans(gone)), hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [say(25) for _ in range(4)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 300, "abc" * 200, "é" * 120, say(400)]
    for _ in range(70):
        parts = [say(rng.randrange(5, 40))]
        if rng.random() < 0.7:
            c = rng.choice(common)
            parts.append(c[rng.randrange(0, 30) : len(c) - rng.randrange(0, 30)])
        if rng.random() < 0.2:
            parts.append(texts[-1] or "")
        parts.append(say(rng.randrange(0, 30)))
        texts.append(rng.choice(["", " "]).join(parts))
    texts += [texts[20], texts[20] + "!", "?" + texts[30]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("chunk", [suffix.CHUNK, 3])
def test_removal_against_brute_force(spark, chunk):
    rows = corpus(8)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, mark int")
    out = suffix.deduplicated(docs, chunk=chunk).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows)


def test_suffix_order_against_sorting():
    rng = random.Random(2)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 9))]
        places = suffix.suffix_places(parts)
        order = sorted((p[o:] + b"", i, o) for i, p in enumerate(parts) for o in range(len(p)))
        at = {(i, o): int(places[i][o]) for i, p in enumerate(parts) for o in range(len(p))}
        ranked = [at[i, o] for _, i, o in order]
        assert len(set(ranked)) == len(ranked)
        strings = [s for s, _, _ in order]
        by_place = [parts[i][o:] for (i, o), _ in sorted(at.items(), key=lambda kv: kv[1])]
        assert by_place == strings


def test_repeated_ids_nulls_and_empty(spark):
    long = "0123456789" * 9 + "abcdefghij" * 3
    docs = spark.createDataFrame([(1, long), (1, long), (1, long + "tail"), (None, None), (None, "z" + long)], "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix.deduplicated(docs).collect())
    assert out == [(-1, 0, 0), (-1, 121, 0), (1, 120, 120), (1, 120, 120), (1, 124, 120)]
    assert suffix.deduplicated(docs.limit(0)).count() == 0


def test_long_texts(spark):
    rng = random.Random(12)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [(1, long[:150_000]), (2, long[100_000:]), (3, "z" * 120_000)]
    out = suffix.deduplicated(spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, lo binary"), keep_bytes=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in out} == {1: (150_000, 0, 0), 2: (len(long) - 100_000, 50_000, 1), 3: (120_000, 119_999, 1)}
