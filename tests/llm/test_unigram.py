import random

import public_tokenizers as P
import pytest

from tidewatch.llm import unigram


def brute(u, word):
    """Best score, then fewest tokens, over all segmentations, prefix by prefix."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        w = len(word[end - 1].encode())
        options = [(best[end - 1][0] + u.byte * w, best[end - 1][1] + w)]
        options += [(best[a][0] + u.pieces[word[a:end]], best[a][1] + 1) for a in range(end) if word[a:end] in u.pieces]
        top = max(s for s, _ in options)
        best.append(min((n, -s) for s, n in options if s >= top - 1e-12)[::-1])
        best[-1] = (-best[-1][0], best[-1][1])
    return best[-1][1]


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.Unigram.from_file(P.path("piece_bpe_32k.model"))


def test_counts_against_brute_force(vocabulary):
    rng = random.Random(6)
    words = ["the", "unhappiness", "é", "漢字", "x" * 50, "\U0001f600a", "the" * 100, "The", "Theory", "theories"]
    words += ["".join(rng.choice("abcdeéthinsor.") for _ in range(rng.randrange(1, 15))) for _ in range(300)]
    texts = [" ".join(rng.sample(words, 20)) for _ in range(30)] + ["", None, " \n\t"]
    tokens, pre = vocabulary.count_all(texts)
    for t, n, k in zip(texts, tokens, pre, strict=True):
        w = (t or "").split()
        assert k == len(w) and n == sum(brute(vocabulary, unigram.MARK + x) for x in w)
    toy = unigram.Unigram({"a": -1.0, "ab": -1.5, "b": -0.5, "▁": -1.0, "▁a": -1.2})
    assert toy.count_all(["ab abab", "c"]) == ([2 + brute(toy, "▁abab"), brute(toy, "▁c")], [2, 1])


def test_long_words_need_no_trie(vocabulary):
    word = "".join(random.Random(1).choice("abcdeéthinsor") for _ in range(900))
    assert vocabulary.count_all([word])[0] == [brute(vocabulary, unigram.MARK + word)]


def test_query_over_a_table(spark, vocabulary):
    rows = [(1, "the theory", 5), (1, "the theory", 5), (None, None, 5), (2, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = unigram.counted(docs, P.path("piece_bpe_32k.model")).collect()
    n = vocabulary.count_all(["the theory"])[0][0]
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_pre_tokens) for r in out) == [(0, 0, 0), (1, n, 2), (1, n, 2), (2, 0, 0)]
    assert unigram.counted(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0
