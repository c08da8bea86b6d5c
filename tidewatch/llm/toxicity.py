"""Toxic passages by maximum-scoring segment search.

Every token has log-odds between toxic and clean documents, above and below zero.  They are estimated with Dirichlet
priors in a chain: a token's prior has the rate of its longest beginning, that one's the rate of the next shorter one, and
the first the rate of all tokens; so inflected and compound forms share evidence, and evidence that a token has of its own
outweighs it.  What is counted is different neighbours: a token counts once for each token before it, so that passages
copied a thousand times count once.

One linear scan over a text's log-odds, less a constant cost of a token, finds every maximal scoring segment.  Scores of
such segments in clean texts follow an extreme-value law; its rate comes from the clean documents' token scores, its
constant from their best segments.  What the significant segments of a document exceed the law's level by is summed, and
a logistic curve turns the sum into a probability.  The documents that the odds were counted on are left out of their own
odds when the law and the curve are fitted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrow import bounded_batches, map_rows
from tidewatch.llm.store import staged

#: Labelled documents of each class that the model is fitted on, at most (the least by hash of the id).
SAMPLE = 12_000
#: Pseudo-neighbours of a prior in the chain, cost of a token in a segment.
PRIOR, COST = 30.0, 1.0
#: Code points of the beginnings of tokens that form the chain.
BEGINNINGS = (3, 4, 5, 6, 8)
#: Neighbours that a feature has been seen with, at least: one alone says nothing that its prior does not.
LEAST = 2
#: Bytes of tokens whose scores a task keeps; pairs of neighbours that a task gathers before it hands them on.
KEPT, FLUSH = 30_000_000, 100_000
#: ASCII that ends a token, and what does so beyond ASCII; scripts that are written without spaces.
BREAK = bytes(32 if chr(i) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
BEYOND = re.compile(r"[\u0080-\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]")
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def in_twos(run: re.Match) -> str:
    """Overlapping pairs of the code points of a run without spaces, each a token."""
    x = run[0]
    return f" {' '.join(x[i : i + 2] for i in range(max(1, len(x) - 1)))} "


def tokens_of(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if not low.isascii():
        low = UNSPACED.sub(in_twos, BEYOND.sub(" ", low))
    return low.encode("utf-8", "surrogatepass").translate(BREAK).split()


def hash_of(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def keys_of(token: bytes) -> list[int]:
    """Keys of the token's beginnings, the shorter first, and of the whole (0 for beginnings that it is too short for)."""
    key = xxhash.xxh3_64_intdigest
    if token.isascii():
        n = len(token)
        return [key(token[:k]) if n > k else 0 for k in BEGINNINGS] + [key(token + b" ")]
    t = token.decode("utf-8", "replace")
    n = len(t)
    return [key(t[:k].encode("utf-8", "replace")) if n > k else 0 for k in BEGINNINGS] + [key(token + b" ")]


@dataclass
class Model:
    """Counts by feature key (toxic, clean), the classes' share, the law's rate and constant, and the logistic curve."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    share: float = 0.5
    rate: float = 1.0
    constant: float = 1.0
    slope: float = 0.0
    offset: float = -2.0
    cost: float = COST

    def odds(self, tokens: list[bytes], own: int | None = None) -> np.ndarray:
        """Log-odds of ``tokens``; ``own`` is the class of a document that the counts hold and that is left out here."""
        keys = np.array([keys_of(t) for t in tokens], np.uint64).reshape(-1, len(BEGINNINGS) + 1)
        mean = np.full(len(tokens), self.share)
        for k in keys.T:
            at = np.minimum(np.searchsorted(self.keys, k), max(0, len(self.keys) - 1))
            hit = (self.keys[at] == k) & (k != 0) if len(self.keys) else np.zeros(len(k), bool)
            a, c = ((np.where(hit, x[at], 0) if len(x) else np.zeros(len(k))) for x in (self.toxic, self.clean))
            a, c = np.maximum(0, a - (own == 1)), np.maximum(0, c - (own == 0))
            mean = (a + PRIOR * mean) / (a + c + PRIOR)
        return np.log(mean / (1 - mean)) - math.log(self.share / (1 - self.share))

    def scorer(self, own: int | None = None) -> Callable[[list[list[bytes]]], list[np.ndarray]]:
        """The function from texts' tokens to their scores.  It keeps tokens' scores, and starts afresh when they take
        too many bytes."""
        kept: dict[bytes, float] = {}
        room = KEPT

        def score(texts: list[list[bytes]]) -> list[np.ndarray]:
            nonlocal room
            new = list({t for tokens in texts for t in tokens if t not in kept})
            if (room := room - sum(map(len, new)) - 120 * len(new)) < 0:
                kept.clear()
                new = list({t for tokens in texts for t in tokens})
                room = KEPT - sum(map(len, new)) - 120 * len(new)
            kept.update(zip(new, (self.odds(new, own) - self.cost).tolist(), strict=True))
            return [np.fromiter(map(kept.__getitem__, tokens), float, len(tokens)) for tokens in texts]

        return score

    def excess(self, found: list[float], n: int) -> float:
        """Sum of what the segments' scores exceed the law's level for a document of ``n`` tokens by."""
        level = math.log(self.constant * max(n, 1))
        return sum(x for s in found if (x := self.rate * s - level) > 0)

    def probability(self, excess: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.offset + self.slope * excess))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after last, score) in order, in linear time.

    A stack holds candidates with the sums before and after each; a new positive score joins back to the last candidate
    that starts lower, if the sum has risen since.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    up = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, next lower candidate
    for i, left, right in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist(), strict=True):
        first, end = i, i + 1
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, end, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
    return [(a, b, r - left) for a, b, left, r, _ in stack]


def rate_of(values: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum p(s) exp(rate * s) = 1 over token scores, by bisection."""
    if not len(values) or values.max() <= 0:
        return 1.0
    p = weight / weight.sum()
    over = lambda x: float((p * np.exp(np.clip(x * values, -700, 700))).sum()) > 1
    low, high = 1e-6, 1.0
    if over(low):  # the mean is not below zero: no law; keep scores as they are
        return 1.0
    while not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def constant_of(best: np.ndarray, n: np.ndarray, rate: float) -> float:
    """Most likely constant K of the law P(best <= s) = exp(-K n exp(-rate s)) for documents of ``n`` tokens."""
    if not len(best):
        return 1.0
    return float(np.clip(len(best) / max(1e-300, float((n * np.exp(-rate * best)).sum())), 1e-9, 1e9))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a weak ridge; the slope is never negative."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-2 * a, (weight * (p - y)).sum() + 1e-3 * b])
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, a), b


def fold(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """Staged ``doc_id, toxic, text`` of a bounded sample of the labelled documents outside fold 0, one row an id, and the
    weight of a row of each class.

    An id with several labels counts as toxic if one says so; of several texts under an id the least is taken.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.where(F.col("toxic") == c).orderBy("turn", "doc_id").limit(sample) for c in sizes]
    if not drawn:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("toxic"), F.col(text_col).alias("text")).limit(0), {}
    chosen = drawn[0] if len(drawn) == 1 else drawn[0].unionAll(drawn[1])
    chosen = staged(chosen.select("doc_id", "toxic"), "chosen")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = staged(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    return texts, {c: max(1.0, n / sample) for c, n in sizes.items()}


def feature_counts(texts: DataFrame) -> tuple[DataFrame, float]:
    """``k, a, c``: features' keys with the different neighbours that they have in toxic documents and in clean ones; and the
    share of toxic neighbours among all."""
    bounded_batches(texts)
    pair = pa.schema([("token", pa.binary()), ("toxic", pa.int32()), ("before", pa.int64())])

    def pairs(batches):  # noqa: ANN001, ANN202
        seen: set[tuple[bytes, int, int]] = set()

        def flush():  # noqa: ANN202
            rows = list(zip(*seen, strict=True)) or [[], [], []]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, pair, strict=True)], schema=pair)

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, last = tokens_of(text), 0
                for t in tokens:
                    seen.add((t, toxic, last))
                    last = hash_of(t)
                    if len(seen) >= FLUSH:
                        yield flush()
        yield flush()

    features = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("c", pa.int64())])

    def explode(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            k, a, c = [], [], []
            for token, in_toxic, in_clean in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                own = [x for x in keys_of(token) if x]
                k += own
                a += [in_toxic] * len(own)
                c += [in_clean] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(k, np.uint64).view(np.int64)), pa.array(a, pa.int64()), pa.array(c, pa.int64())], schema=features)

    found = texts.select("text", "toxic").mapInArrow(pairs, "token binary, toxic int, before long").distinct()
    words = found.groupBy("token").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"))
    words = staged(words, "tokens")
    total = words.agg(F.sum("a").alias("a"), F.sum("c").alias("c")).first()
    counts = words.mapInArrow(explode, "k long, a long, c long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    return counts.where(F.col("a") + F.col("c") >= LEAST), ((total["a"] or 0) + 1) / ((total["a"] or 0) + (total["c"] or 0) + 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each class; ``labels`` has doc_id and toxic (0, 1, null)."""
    texts, weight = labelled(docs, labels, id_col, text_col, sample)
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(offset=2.0 if toxic else -2.0)
    counts, share = feature_counts(texts)
    rows = counts.toArrow()  # of the bounded sample, three numbers a feature
    keys, a, c = (rows.column(x).to_numpy() for x in ("k", "a", "c"))
    order = np.argsort(keys.view(np.uint64), kind="stable")
    model = Model(keys.view(np.uint64)[order], a[order].astype(np.int32), c[order].astype(np.int32), share)

    def make():  # noqa: ANN202
        score = [model.scorer(own) for own in (0, 1)]

        def run(values: list, classes: list) -> dict:
            out: dict[str, list] = {"n": [], "levels": [], "times": [], "found": []}
            for text, own in zip(values, classes, strict=True):
                s = score[own]([tokens_of(text)])[0]
                levels, times = np.unique(np.round(s, 2), return_counts=True)
                out["n"].append(len(s))
                out["levels"].append(levels)
                out["times"].append(times)
                out["found"].append([x for _, _, x in maximal_segments(s)])
            return out

        return run

    seen = staged(map_rows(texts, make, "n long, levels array<double>, times array<long>, found array<double>", ["text", "toxic"], ["toxic"]), "seen")
    hits = seen.where("toxic = 0").select(F.explode(F.arrays_zip("levels", "times")).alias("x")).groupBy("x.levels").agg(F.sum("x.times").alias("times")).toArrow()
    model.rate = rate_of(hits.column("levels").to_numpy(), hits.column("times").to_numpy().astype(float))
    rows = seen.select("toxic", "n", "found").collect()  # of the bounded sample, segments' scores only
    of_clean = [(max(r.found, default=0.0), r.n) for r in rows if r.toxic == 0 and r.n]
    model.constant = constant_of(*np.array(of_clean, float).reshape(-1, 2).T, model.rate)
    x, y = np.array([model.excess(r.found, r.n) for r in rows]), np.array([float(r.toxic) for r in rows])
    model.slope, model.offset = logistic(x, y, np.array([weight[r.toxic] for r in rows]))
    return model


def scored(docs: DataFrame, model: Model, through: list[str], text_col: str = "text", keep_segments: bool = True) -> DataFrame:
    """The columns ``through`` of ``docs`` with ``score`` and, if kept, ``segments``: every maximal segment as (first token,
    end, score, e_value).

    The text is all that is scored.  A null or empty text has no tokens and so no segment; it gets the score of such texts.
    """

    def make():  # noqa: ANN202
        score = model.scorer()

        def run(texts: list) -> dict:
            out: dict[str, list] = {"segments": [], "score": []}
            for scores in score([tokens_of(t) for t in texts]):
                found = maximal_segments(scores)
                out["score"].append(model.probability(model.excess([s for _, _, s in found], len(scores))))
                if keep_segments:
                    e = model.constant * len(scores)
                    out["segments"].append([{"first": a, "end": b, "score": s, "e_value": e * math.exp(-model.rate * s)} for a, b, s in found])
            return out

        return run

    new = "segments array<struct<first: int, end: int, score: double, e_value: double>>, " * keep_segments + "score double"
    return map_rows(docs, make, new, [text_col], through)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_segments: bool = True) -> DataFrame:
    """``doc_id, held_out, segments, score, predicted`` for every row of ``docs``; the model never sees fold 0.

    Whole texts are scored, however long, in linear time.  Repeated rows and ties are scored alike; a null id is not held
    out; an empty table gives an empty result, and one without labels of both kinds the same score to all.  Other columns
    are ignored, whatever their names.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"], keep_segments=keep_segments)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``most``, all columns as they were."""
    rows = docs.select([F.col(c).alias(f"_{c}") for c in docs.columns] + [F.col(text_col).alias("text")])
    kept = scored(rows, model, [f"_{c}" for c in docs.columns], keep_segments=False).where(F.col("score") < most)
    return kept.select([F.col(f"_{c}").alias(c) for c in docs.columns])
