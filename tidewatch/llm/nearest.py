"""Nearest neighbours by multi-index hashing of learned binary codes.

A vector's code holds the signs of its coordinates under rotations that are learned to lose little by taking signs.
Codes are cut into substrings of 16 bits, each with an index of its own.  Codes within a Hamming radius r of a query
agree with it, in one of the m substrings, up to r // m bits (pigeonhole, with the remainder shared out), so probing all
values that near in every substring finds every code within r.  What is found is reranked by the cosine of the original
vectors.  The radius is set on a bounded sample, so that it holds nearly all true neighbours.

Equal vectors are one entry with its smallest ids.  Entries and queries are dealt in blocks; a task holds one block of
either, so the memory that it needs does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.arrow import bounded_batches
from tidewatch.llm.store import staged

#: Vectors that the rotations and the radius are fitted on, and those of them that serve as queries, at most.
SAMPLE, TRIED = 8192, 512
#: Rotations (each gives a bit per dimension), steps of fitting one, share of true neighbours that the radius must hold.
ROTATIONS, STEPS, HELD = 2, 30, 0.985
#: Bits of a substring.
BITS = 16
#: Entries and queries of a block; parts into which the ids of equal vectors are dealt before the smallest are taken.
BLOCK, SALT = 16_384, 64


@dataclass
class Codes:
    """Rotations (dimension x bits) and the Hamming radius within which neighbours are looked for."""

    turn: np.ndarray
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Substrings (rows x m, 16 bits each) of unit vectors' codes."""
        bits = np.packbits(unit @ self.turn > 0, axis=1)
        wide = -(-bits.shape[1] // 2) * 2
        return np.pad(bits, ((0, 0), (0, wide - bits.shape[1]))).view(np.uint16)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two so that their largest component is near 1: no cosine changes, none overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1]) if x.size else x


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix under which the signs of ``x`` are as near to its coordinates as alternating steps get them."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(STEPS):
        u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
        r = u @ vt
    return r


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of one code to many."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def fitted(sample: np.ndarray, k: int) -> Codes:
    unit = unit_rows(sample) if len(sample) else np.zeros((0, max(1, sample.shape[1])))
    rng = np.random.default_rng(7)
    if not len(unit):
        return Codes(np.eye(unit.shape[1]), 0)
    codes = Codes(np.hstack([rotation(unit, rng) for _ in range(ROTATIONS)]), 0)
    own, far = codes.of(unit), []
    for i in range(0, len(unit), max(1, len(unit) // TRIED)):
        near = unit @ unit[i]
        near[i] = -2
        best = np.argsort(-near)[: min(k, len(unit) - 1)]
        far.append(distances(own[i], own[best]))
    spread = np.concatenate(far) if far else np.zeros(0)
    codes.radius = int(np.quantile(spread, HELD)) + 1 if len(spread) else codes.turn.shape[1]
    return codes


MASKS: dict[int, np.ndarray] = {}


def masks(most: int) -> np.ndarray:
    """All 16-bit values with up to ``most`` bits."""
    if most not in MASKS:
        MASKS[most] = np.array([sum(1 << i for i in c) for w in range(min(most, BITS) + 1) for c in combinations(range(BITS), w)], np.uint16)
    return MASKS[most]


class Index:
    """A block of entries: for every substring, its values, which entries have each, and which value each entry has."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.values, self.order, self.first, self.which = [], [], [], []
        for s in range(codes.shape[1]):
            values, which = np.unique(codes[:, s], return_inverse=True)
            order = np.argsort(which, kind="stable")
            self.values.append(values)
            self.which.append(which)
            self.order.append(order)
            self.first.append(np.searchsorted(which[order], np.arange(len(values) + 1)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Entries whose codes are within ``radius`` of ``code``: all of them, by the pigeonhole principle."""
        least, more = divmod(radius, len(self.values))
        seen = np.zeros(len(self.codes), bool)
        for s, values in enumerate(self.values):
            reach = least if s <= more else least - 1
            if reach < 0:
                continue
            if reach >= 4 or len(masks(reach)) > len(values):  # fewer values than probes: look at the values
                seen |= (np.bitwise_count(values ^ code[s]) <= reach)[self.which[s]]
                continue
            probes = masks(reach) ^ code[s]
            at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
            for i in at[values[at] == probes]:
                seen[self.order[s][self.first[s][i] : self.first[s][i + 1]]] = True
        found = np.flatnonzero(seen)
        return found[distances(code, self.codes[found]) <= radius]


def nearest_in(index: Index, entries: np.ndarray, code: np.ndarray, query: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` entries of largest cosine, with ties at the end, of those within the radius; it is widened until there
    are ``k`` entries, or all."""
    bits = index.codes.shape[1] * BITS
    found = index.within(code, radius)
    while len(found) < min(k, len(entries)) and radius < bits:
        radius = min(bits, radius + 8)
        found = index.within(code, radius)
    near = entries[found]
    score = (near @ query) / (np.sqrt((near * near).sum(axis=1)) * np.sqrt((query * query).sum()))
    if len(found) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= least
        found, score = found[keep], score[keep]
    return found, score


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors`` (vec_id, v) -> entries ``entry, v, ids``: distinct vectors with the k + 1 smallest ids of each.

    The ids of equal vectors are cut down in two steps, so that a vector that many rows share is spread over tasks.
    """
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)))
    some = salted.withColumn("turn", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("turn") <= k + 1)
    few = some.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("turn") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return staged(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: one vector for each id; those that are null, zero or not finite throughout take no part, nor rows
    without an id, nor vectors of another length than most have."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), (fine & nonzero).alias("ok"))
    rows = staged(rows.where("ok").groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def searched(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest of every vector whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    Nearness is the cosine in double precision; ties go to the smaller id; the query's own id is no candidate.  Fewer
    rows come only where there are fewer candidates.  Where an id is repeated, its least vector (by elements) stands for
    it.  Extra columns are ignored; an empty table gives an empty result.
    """
    vectors = valid(rows, id_col, vector_col)
    entries = classes_of(vectors, k)
    queries = vectors.where(F.col("vec_id") % every == 0).join(entries.select("entry", F.col("v").alias("w")), F.col("v") == F.col("w"))
    queries = staged(queries.select(F.col("vec_id").alias("query_id"), "entry"), "queries")
    asked = staged(entries.join(queries.select("entry").distinct(), "entry", "left_semi").select("entry", "v"), "asked")
    n, q = entries.count(), asked.count()
    drawn = entries.select("v", F.xxhash64("v").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 20)) + 1))
    sample = drawn.orderBy("h", "v").limit(SAMPLE).select("v").collect()
    codes = fitted(np.array([r.v for r in sample], float) if sample else np.zeros((0, 1)), k)
    turn, radius = codes.turn, codes.radius
    entry_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-q // block))
    mine = lambda x, b: F.pmod(F.xxhash64(x), F.lit(b)).cast("int")
    none = F.lit(None).cast("array<long>")
    left = entries.select(mine("entry", entry_blocks).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("b"), F.lit(0).alias("kind"), "entry", "v", "ids")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(entry_blocks - 1))).alias("a"), mine("entry", query_blocks).alias("b"), F.lit(1).alias("kind"), "entry", "v", none.alias("ids"))
    cells = left.unionAll(right).repartition("a", "b").sortWithinPartitions("a", "b", "kind")
    bounded_batches(rows)

    def answer(kinds: np.ndarray, numbers: np.ndarray, v: np.ndarray, ids: list) -> Iterator[pa.RecordBatch]:
        mask = kinds == 0
        held = np.flatnonzero(mask)
        ask = np.flatnonzero(~mask)
        if not len(held) or not len(ask):
            return
        own = Codes(turn, radius)
        index, points = Index(own.of(unit_rows(v[held]))), v[held]
        out: tuple[list, list, list] = ([], [], [])
        for i, code in zip(ask, own.of(unit_rows(v[ask])), strict=True):
            found, score = nearest_in(index, points, code, v[i], radius, k + 1)
            rows = sorted((-s, x) for f, s in zip(found.tolist(), score.tolist(), strict=True) for x in ids[held[f]])[: k + 1]
            for s, x in rows:
                out[0].append(int(numbers[i]))
                out[1].append(x)
                out[2].append(-s)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["entry", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                kinds, numbers, v = (np.concatenate([p[j] for p in parts]) for j in range(3))
                yield from answer(kinds, numbers, scaled(v), [x for p in parts for x in p[3]])

        for batch in batches:
            a, b, kinds, numbers = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            v = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            ids = batch.column(5).to_pylist()
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if low == high:
                    continue
                if cell != (a[low], b[low]):
                    yield from done()
                    cell, parts = (a[low], b[low]), []
                parts.append((kinds[low:high], numbers[low:high], v[low:high], ids[low:high]))
        yield from done()

    found = cells.mapInArrow(run, "entry long, vec_id long, score double")
    nearest = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= k + 1).drop("turn")
    mine_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.join(best, "entry").where("query_id != vec_id").withColumn("rank", F.row_number().over(mine_first))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
