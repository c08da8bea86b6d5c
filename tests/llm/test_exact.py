from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import exact

TEXTS = ["", None, "Ab", "aB", "ab ", "É", "é", "x" * 50, "X" * 50, "x" * 49, "abcdefgh" * 7, "ABCDEFGH" * 7, "abcdefgh" * 6 + "abcdefgx", "\U0001f600" * 9, "\U0001f600" * 10]


def brute(rows):
    low = str.maketrans(exact.UPPER, exact.LOWER)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(low)].append(i)
    return {(t or "").translate(low): (max(g := groups[(t or "").translate(low)]), len(g)) for _, t in rows}


def check(spark, key=None):
    rows = [(i * 3 % 31, t) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame([(i, t, "n", "k") for i, t in rows], "doc_id long, text string, name string, key string")
    want = brute(rows)
    low = str.maketrans(exact.UPPER, exact.LOWER)
    out = exact.exact_groups(docs, block=8).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    text = dict(rows)
    for r in out:
        keep, size = want[(text[r.doc_id] or "").translate(low)]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)


def test_groups_against_brute_force(spark):
    check(spark)


def test_clashing_keys_do_not_join_different_texts(spark):
    rows = [(i, t or "") for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame([(i, b"", b"", t) for i, t in rows], "id long, sha binary, text_sha binary, text string")
    out = exact.identities(docs, block=8, key=F.length("block").cast("long")).collect()
    low = str.maketrans(exact.UPPER, exact.LOWER)
    name, text = {r.id: (r.level, r.name) for r in out}, dict(rows)
    assert len(name) == len(rows)
    for i in text:
        for j in text:
            assert (name[i] == name[j]) == (text[i].translate(low) == text[j].translate(low))


def test_repeated_rows_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    out = exact.exact_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]
    assert exact.exact_groups(docs.limit(0)).count() == 0
    assert sorted(map(tuple, exact.drop_copies(docs).collect()), key=str) == sorted([(1, "a"), (None, None)], key=str)


def test_names_that_clash_long_texts_and_hot_repeats(spark):
    long = "Word " * 60_000
    rows = [(1, long, 7, 8, 9), (2, long.lower(), 7, 8, 9), (2, long.lower(), 7, 8, 9)] + [(5, "hot", k, 0, 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha long, id_of long, sha_of long")
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.sha_of) for r in kept.collect()) == [(2, 9), (5, 0)]
    named = docs.selectExpr("doc_id", "text", "sha AS id", "id_of AS times", "sha_of AS best")
    assert exact.drop_copies(named).columns == named.columns
    assert sorted({(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_groups(named).collect()}) == [(1, 2, 3), (2, 2, 3), (5, 5, 300)]
