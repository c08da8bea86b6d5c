import hashlib
import io
import random

from tidewatch.llm import warc


def test_records_round_trip_with_and_without_dictionary():
    rng = random.Random(1)
    bodies = [bytes(rng.choice(b"<p>abc</p> ") for _ in range(rng.randrange(0, 5000))) for _ in range(60)] + [b"", b"\r\n\r\nWARC/1.1\r\n", bytes(3 << 20)]
    import zstandard

    for dictionary in (b"", zstandard.train_dictionary(4096, bodies[:60]).as_bytes()):
        out = io.BytesIO()
        w = warc.Writer(out, dictionary)
        for i, b in enumerate(bodies):
            w.write(warc.page_record(i, "http://x/\r\ny", b, hashlib.sha1(b).hexdigest(), None))
        out.seek(0)
        back = [warc.parsed(r) for r in warc.records(out)]
        assert [b for _, b in back] == bodies and back[0][0]["WARC-Target-URI"] == "http://x/%0D%0Ay"
        assert out.getvalue()[:4] == (b"\x5d\x2a\x4d\x18" if dictionary else b"\x28\xb5\x2f\xfd")
    shorter = out.getvalue()[:-5]
    try:
        list(warc.records(io.BytesIO(shorter)))
        raise AssertionError("a cut archive was read to the end")
    except ValueError:
        pass


def test_query_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        n = rng.choice([0, 10, 500, 999, 1000, 1001, 3000])
        html = None if n == 0 else "é" * (n // 2) + "x" * (n % 2) if i % 3 else str(i % 7) * n
        rows.append((i * 7 % 121, f"http://h/{i}", html, "clash"))
    rows += [(5000, None, "long " * 400, "c"), (5000, None, "long " * 400, "c"), (4000, "u", "long " * 400, "c"), (None, "u", "long " * 400, "c"), (None, "u", "only " * 400, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    out = warc.archived(pages).drop("payload").collect()
    payload = lambda r: (r[2] or "").encode()
    best, times = {}, {}
    for r in rows:
        p = payload(r)
        if r[0] is not None:
            best[p] = max(best.get(p, -1), r[0])
        times[p] = times.get(p, 0) + 1
    want = []
    for r in rows:
        p = payload(r)
        revisit = len(p) >= 1000 and times[p] > 1 and best.get(p) != r[0] and p in best
        want.append((-1 if r[0] is None else r[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", best[p] if revisit else -1))
    got = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in out]
    assert sorted(got) == sorted(want)
    assert warc.archived(pages.limit(0)).count() == 0
