import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidewatch.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "a" * 3000, "Ünïcødé  é́ \U0001f600​", "don't I'll  'S", "0123456789 ٣٤", "\x00\x7f\t\r\n", "汉字" * 400, "  　 ."]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.from_file(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def known(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(codec):
    h = codec.hash
    assert sorted(h.find(w) for w in codec.ranks) == list(range(len(codec.ranks)))
    assert h.find(b"\xff\xfe no such") == -1 and bpe.PerfectHash([]).find(b"a") == -1


def test_ids_match_the_known_library(codec, known):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcde thé\n.1漢") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == known.encode_ordinary(t)
        assert codec.joined(t) == ",".join(map(str, ids)) and codec.decode_joined(codec.joined(t)) == t.encode()
        assert codec.decode(ids) == t.encode()


def test_query_over_a_table(spark, known):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "y"), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encoded(docs, PATH, P.PATTERN).collect()
    assert len(out) == len(rows)
    want = {i: known.encode_ordinary(t or "") for i, t, _ in rows}
    for r in out:
        assert list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.encoded(docs.limit(0), PATH, P.PATTERN).count() == 0
