"""Removal of repeated byte strings by a column-wise Burrows-Wheeler transform of many documents.

Every window of ``LENGTH`` bytes has an anchor: the leftmost of its grams of least hash.  Equal windows have equal
anchors at equal places, so windows need comparing only under one anchor, and an anchor that comes once repeats nothing.
A run of windows with one anchor is a segment of text.  Equal segments are settled by aggregation: all but the first are
repeats.  The different segments of an anchor are gathered, and their suffixes are sorted together: round by round one
symbol per segment, from the last to the first, is inserted into the transform of the collection, at the place that the
transform so far gives by counting.  Windows that come to stand side by side in that order and share ``LENGTH`` bytes are
equal, and all but the first in the corpus are repeats.

A collection is of bounded size.  An anchor with more segments than that is dealt over several collections; windows that
are new in each are then compared by digest across them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrow import SLICE, bounded_batches, map_rows
from tidewatch.llm.store import drop, staged

#: Bytes of a string that must not repeat; bytes of a gram.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Segments of a collection, at most, and those of one anchor in it.
COLLECTION, CHUNK = 16_000, 8_192
#: Segments that a task gathers before it deals them out to collections by length.
GATHERED = 4 * COLLECTION
#: Bits of a block's size in which the transform's symbols are counted.
BITS = 8
#: Bytes beside an anchor, on one side or the other, that two segments with a common window must share.
BESIDE = (LENGTH - GRAM) // 2
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX
        return x ^ (x >> np.uint64(27))


SYMBOLS = spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def grams(b: np.ndarray) -> np.ndarray:
    """Hash of every run of ``GRAM`` bytes (a power of two), by doubling."""
    h, n = SYMBOLS[b], 1
    with np.errstate(over="ignore"):
        while n < GRAM:
            h = (h[:-n] * ODD) ^ h[n:]
            h ^= h >> np.uint64(31)
            n *= 2
    return h


def runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, its place, first window, number of windows."""
    h = grams(b)
    at, k = np.arange(len(h)), 1
    while 2 * k <= SPAN:
        left, right = at[:-k], at[k:]
        at, k = np.where(h[right] < h[left], right, left), 2 * k
    if rest := SPAN - k:
        left, right = at[:-rest], at[rest:]
        at = np.where(h[right] < h[left], right, left)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]], at[first], first, np.diff(np.r_[first, len(at)])


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: Powers of an odd number and of its inverse, for hashes of segments; as many as a slice of a text has bytes.
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``BASE`` and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        up, down = (np.full(n, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
        up[:1] = down[:1] = 1
        return np.cumprod(up), np.cumprod(down)


def hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each segment [start, stop): a polynomial in its bytes, from sums over the text (segments are short, so
    that its period does no harm), then mixed."""
    up, down = powers(len(b))
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(SYMBOLS[b] * up)]
        return spread((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def segments(docs: DataFrame) -> DataFrame:
    """One row per run: ``doc_id, mark, a, lo, n, off, fp`` (first window, windows, the anchor's offset, segment's hash)."""
    bounded_batches(docs)
    names = ["doc_id", "mark", "a", "lo", "n", "off", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
                for i, m, t in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True):
                    b = np.frombuffer(bytes_of(t), np.uint8)
                    if len(b) < LENGTH:
                        continue
                    a, at, first, n = runs(b)
                    fp = hashes(b, first, first + n + LENGTH - 1)
                    for k, x in enumerate((np.full(len(a), i), np.full(len(a), m), a.view(np.int64), first, n, at - first, fp.view(np.int64))):
                        found[k].append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(found, kinds, strict=True)], names=names)

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, a long, lo int, n int, off int, fp long")


def suffix_places(parts: list[bytes]) -> list[np.ndarray]:
    """Where each suffix of each part stands in the sorted order of all suffixes of all parts.

    Column by column: the transform ``b`` holds, for each suffix so far, the symbol before it (0: none left).  The suffix
    that this symbol begins stands behind all that begin with a smaller one, by as many places as the symbol comes in
    the transform before its own.  So a round's new suffixes, one a part, are placed by counting and merged in.
    """
    m = len(parts)
    used = np.zeros(256, bool)
    for p in parts:
        used[np.frombuffer(p, np.uint8)] = True
    code = np.zeros(256, np.uint16)
    code[used] = np.arange(1, used.sum() + 1)
    kind = np.uint8 if used.sum() < 256 else np.uint16
    text = [code[np.frombuffer(p, np.uint8)].astype(kind) for p in parts]
    length = np.array([len(t) for t in text])
    widest = int(length.max(initial=0))
    back = np.zeros((m, widest + 1), kind)  # symbols from the last to the first, then 0
    for i, t in enumerate(text):
        back[i, : len(t)] = t[::-1]
    b, place, active = back[:, 0].copy(), np.arange(m), np.flatnonzero(length > 0)

    kinds, low = int(code.max()) + 1, np.arange(1 << BITS)

    def counted(b: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each ``symbol`` comes in ``b`` before its place ``at``, and how often all smaller ones of any kind."""
        blocks = (len(b) >> BITS) + 1
        held = np.bincount((np.arange(len(b)) >> BITS) * kinds + b, minlength=blocks * kinds).reshape(blocks, kinds)
        ahead = np.cumsum(held, axis=0)
        begin = np.r_[0, np.cumsum(ahead[-1])]
        whole = np.pad(b, (0, (blocks << BITS) - len(b))).reshape(blocks, -1)
        block = at >> BITS
        inside = (whole[block] == symbol[:, None]) & (low < (at & ((1 << BITS) - 1))[:, None])
        return (ahead - held)[block, symbol] + inside.sum(axis=1), begin

    for turn in range(widest):
        symbol = back[active, turn]
        own, begin = counted(b, place[active], symbol)
        new = own + begin[symbol] + m - begin[1]  # empty suffixes come first; entries without a symbol have none longer
        merged = np.empty(len(b) + len(active), kind)
        fresh = np.zeros(len(merged), bool)
        fresh[new] = True
        merged[~fresh] = b
        merged[new] = back[active, turn + 1]
        b = merged
        place[active] = new
        active = active[length[active] > turn + 1]
        # places of the parts that have ended move, but are never needed again
    step = np.empty(len(b), np.int64)
    step[np.argsort(b, kind="stable")] = np.arange(len(b)) + m - (b == 0).sum()
    found = np.empty((m, widest), np.int64)
    at = np.arange(m)
    for turn in range(widest):
        alive = length > turn
        at[alive] = step[at[alive]]
        found[alive, turn] = at[alive]
    return [found[i, :n][::-1] for i, n in enumerate(length)]


def repeats(parts: list[bytes], starts: list[tuple]) -> list[np.ndarray]:
    """For each part, which of its windows are equal to one that starts earlier; ``starts`` are (id, mark, first byte),
    and windows of one part differ."""
    count = [len(p) - LENGTH + 1 for p in parts]
    places = suffix_places(parts)
    place = np.concatenate([p[:n] for p, n in zip(places, count, strict=True)])
    part = np.repeat(np.arange(len(parts)), count)
    offset = np.concatenate([np.arange(n) for n in count])
    order = np.argsort(place, kind="stable")
    part, offset = part[order], offset[order]
    widest = max(map(len, parts))
    flat = np.frombuffer(b"".join(p.ljust(widest, b"\0") for p in parts), np.uint8).reshape(len(parts), widest)
    view = np.lib.stride_tricks.sliding_window_view(flat, LENGTH, axis=1)
    same = np.zeros(len(part), bool)
    for low in range(1, len(part), 1 << 16):  # side by side in the order: the common prefix reaches a window's length
        i = np.arange(low, min(low + (1 << 16), len(part)))
        same[i] = (view[part[i], offset[i]] == view[part[i - 1], offset[i - 1]]).all(axis=1)
    group = np.cumsum(~same)
    ids, marks, low = (np.array([s[k] for s in starts], np.int64)[part] for k in range(3))
    ranked = np.lexsort((low + offset, marks, ids, group))
    later = np.zeros(len(part), bool)
    later[ranked[1:]] = group[ranked[1:]] == group[ranked[:-1]]
    base = np.r_[0, np.cumsum(count)]
    flags = np.zeros(base[-1], bool)
    flags[base[part[later]] + offset[later]] = True
    return [flags[a:b] for a, b in zip(base, base[1:], strict=False)]


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of flagged windows as (first, number)."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (a, chunk, chunks, doc_id, mark, lo, off, seg) -> ``doc_id, mark, lo, n, digest``.

    Without a digest: ``n`` windows from ``lo`` repeat earlier ones.  With one: the window at ``lo`` is new to its
    chunk, and other chunks of its anchor are to be asked.  Sorted partitions are taken in collections of bounded size.
    """
    bounded_batches(rows)
    names = ["doc_id", "mark", "lo", "n", "digest"]

    def solve(groups: list[list[tuple]]) -> pa.RecordBatch:
        out: list[tuple] = []
        ready: list[list[tuple]] = []
        for group in groups:
            if group[0][2] > 1:
                ready.append(group)
                continue
            # whole anchors: a segment that shares neither side with another has no common window
            sides = [(r[7][r[6] - BESIDE : r[6]] if r[6] >= BESIDE else None, x if len(x := r[7][r[6] + GRAM : r[6] + GRAM + BESIDE]) == BESIDE else None) for r in group]
            seen: dict[tuple, int] = {}
            kept: list[tuple] = []
            for pair in sides:
                for k, x in enumerate(pair):
                    if x is not None:
                        seen[k, x] = seen.get((k, x), 0) + 1
            for r, pair in zip(group, sides, strict=True):
                left, right = (x is not None and seen[k, x] > 1 for k, x in enumerate(pair))
                # a side that is not shared ends less than BESIDE bytes from the anchor in any common window
                low = 0 if left else max(0, r[6] - BESIDE + 1)
                high = len(r[7]) if right else r[6] + GRAM + BESIDE - 1
                if (left or right) and len(seg := r[7][low:high]) >= LENGTH:
                    kept.append((*r[:5], r[5] + low, r[6] - low, seg))
            if len(kept) > 1:
                ready.append(kept)
        # a round costs what the transform holds, so groups of like length go together
        ready.sort(key=lambda g: max(len(r[7]) for r in g))
        while ready:
            part: list[tuple] = []
            while ready and len(part) < COLLECTION:
                part += ready.pop()
            for r, flags in zip(part, repeats([r[7] for r in part], [(r[3], r[4], r[5]) for r in part]), strict=True):
                out += [(r[3], r[4], r[5] + a, n, None) for a, n in spans(flags)]
                if r[2] > 1:
                    out += [(r[3], r[4], r[5] + o, 1, hashlib.blake2b(r[7][o : o + LENGTH], digest_size=16).digest()) for o in np.flatnonzero(~flags).tolist()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if groups and groups[-1][0][:2] == row[:2]:
                    groups[-1].append(row)
                else:
                    if size >= GATHERED:
                        yield solve(groups)
                        groups, size = [], 0
                    groups.append([row])
                size += 1
        if groups:
            yield solve(groups)

    rows = rows.select("a", "chunk", "chunks", "doc_id", "mark", "lo", "off", "seg")
    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk").mapInArrow(run, "doc_id long, mark long, lo int, n int, digest binary")


def removed(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (doc_id, mark, text) -> ``doc_id, mark, lo, hi``: byte ranges to remove, overlapping as they come."""
    every = staged(segments(docs), "segments", large=True)
    twice = staged(every.groupBy("a").count().where("count > 1").select("a"), "repeated", large=True)
    runs_ = staged(every.join(twice, "a", "left_semi"), "runs", large=True)
    drop(every)
    start = F.struct("doc_id", "mark", "lo")
    firsts = runs_.groupBy("a", "fp").agg(F.min(start).alias("first"), F.first("n").alias("n"), F.first("off").alias("off"))
    firsts = staged(firsts, "firsts", large=True)
    copies = runs_.join(firsts.select("a", "fp", "first"), ["a", "fp"]).where(start != F.col("first"))
    found = copies.select("doc_id", "mark", "lo", (F.col("lo") + F.col("n") + LENGTH - 1).alias("hi"))
    found = staged(found, "copies", large=True)
    several = firsts.groupBy("a").agg(F.count("*").alias("k")).where("k > 1")
    several = several.select("a", F.ceil(F.col("k") / chunk).cast("int").alias("chunks"))
    border = firsts.join(several, "a").select("a", "fp", "chunks", "first.*", "n", "off")
    border = border.groupBy(F.col("doc_id").alias("i"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("a", F.pmod("fp", "chunks").alias("chunk"), "chunks", "lo", "n", "off")).alias("cuts"))
    wanted = docs.join(border, (F.col("doc_id") == F.col("i")) & (F.col("mark") == F.col("m"))).select("doc_id", "mark", "text", "cuts")

    def make():  # noqa: ANN202
        def run(texts: list, cuts: list) -> dict:
            out = []
            for t, own in zip(texts, cuts, strict=True):
                raw = bytes_of(t)
                out.append([{"a": c["a"], "chunk": c["chunk"], "chunks": c["chunks"], "lo": c["lo"], "off": c["off"], "seg": raw[c["lo"] : c["lo"] + c["n"] + LENGTH - 1]} for c in own])
            return {"r": out}

        return run

    cut = map_rows(wanted, make, "r array<struct<a: long, chunk: long, chunks: int, lo: int, off: int, seg: binary>>", ["text", "cuts"], ["doc_id", "mark"])
    cut = cut.select("doc_id", "mark", F.explode("r").alias("r")).select("doc_id", "mark", "r.*")
    told = staged(told_apart(staged(cut, "segments", large=True)), "told", large=True)
    flagged = told.where("digest IS NULL").select("doc_id", "mark", "lo", (F.col("lo") + F.col("n") + LENGTH - 1).alias("hi"))
    asked = told.where("digest IS NOT NULL")
    earliest = asked.groupBy("digest").agg(F.min(start).alias("first"))
    across = asked.join(earliest, "digest").where(start != F.col("first")).select("doc_id", "mark", "lo", (F.col("lo") + LENGTH).alias("hi"))
    return found.unionAll(flagged).unionAll(across)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, keep_bytes: bool = True) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if kept, ``kept`` (the remaining bytes).

    Texts are UTF-8 bytes, null as empty.  Removed is every byte that a string of ``LENGTH`` bytes covers which also
    starts earlier: in a document of smaller id, or before in the same one; overlaps count.  A null id is the smallest.
    Rows repeated under one id with equal texts all count as the first of them, so neither repeats the other; rows of
    different texts under one id are ordered by a hash of the text.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("real_id"), F.col(text_col).alias("text"))
    unique = not rows.groupBy("real_id").count().where("count > 1").take(1)
    mark = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.select("real_id", F.coalesce("real_id", lowest).alias("doc_id"), mark.alias("mark"), "text")
    told = rows.select("doc_id", "mark", "text") if unique else rows.select("doc_id", "mark", "text").dropDuplicates(["doc_id", "mark"])
    ranges = removed(told, chunk).groupBy(F.col("doc_id").alias("i"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    ranges = staged(ranges, "ranges", large=True)
    joined = rows.join(ranges, (rows["doc_id"] == ranges["i"]) & (rows["mark"] == ranges["m"]), "left").select(F.col("real_id").alias("doc_id"), "text", "ranges")

    def make():  # noqa: ANN202
        def run(texts: list, found: list) -> dict:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for t, r in zip(texts, found, strict=True):
                raw = bytes_of(t)
                kept, at, n, last = [], 0, 0, -1
                for a, b in sorted((x["lo"], x["hi"]) for x in r or ()):
                    if a > last:
                        kept.append(raw[at:a])
                        n += 1
                    at = last = max(last, b)
                kept.append(raw[at:])
                left = b"".join(kept)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(left))
                out["n_spans"].append(n)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if keep_bytes:
                    out["kept"].append(left)
            return out

        return run

    new = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return map_rows(joined, make, new, ["text", "ranges"], ["doc_id"])
