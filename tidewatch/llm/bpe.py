"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens themselves.  Second
tier: the rest are merged by a heap over linked bytes, lowest rank first.  A pre-token's ids are kept for the next time
it comes, in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrow import map_rows

#: Bytes of the pre-tokens and ids that a worker keeps; the table starts afresh when it is full.
KEPT = 150_000_000
#: Vocabulary entries that share a displacement, on average.
PER_BUCKET = 2


class PerfectHash:
    """Minimal perfect hash (hash and displace) of a set of byte strings: each has a slot of its own in 0 .. n-1."""

    def __init__(self, words: list[bytes]):
        self.n = n = len(words)
        self.buckets = max(1, n // PER_BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        self.words: list[bytes] = [b""] * n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for w in words:
            h = xxhash.xxh64_intdigest(w)
            groups.setdefault(h % self.buckets, []).append((h, w))
        taken = bytearray(n)
        order = sorted(groups.items(), key=lambda x: (-len(x[1]), x[0]))
        for bucket, group in order:
            if len(group) == 1:
                break
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in group]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for s, (_, w) in zip(slots, group, strict=True):
                taken[s] = 1
                self.words[s] = w
        free = (s for s in range(n) if not taken[s])  # a bucket of one word names its slot outright
        for bucket, group in order:
            if len(group) == 1:
                s = next(free)
                self.shift[bucket], self.words[s] = -1 - s, group[0][1]
        self._shift = self.shift.tolist()

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 20) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def find(self, word: bytes) -> int:
        """The slot of ``word``, or -1 if it is not in the set."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(word)
        d = self._shift[h % self.buckets]
        s = self._slot(h, d) if d >= 0 else -1 - d
        return s if self.words[s] == word else -1


class Kept(dict):
    """Pre-tokens and their ids, as decimals joined by commas; fills itself, and starts afresh when full."""

    def __init__(self, codec: Codec):
        self.codec, self.room = codec, KEPT

    def __missing__(self, pre_token: str) -> str:
        found = ",".join(map(str, self.codec.ids(pre_token.encode("utf-8", "surrogatepass"))))
        self.room -= len(pre_token) + len(found) + 150
        if self.room < 0:
            self.clear()
            self.room = KEPT
        self[pre_token] = found
        return found


class Codec:
    """Encoder and decoder for a vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        words = list(ranks)
        self.hash = PerfectHash(words)
        self.id_of_slot = [ranks[w] for w in self.hash.words]
        self.bytes_of = {i: w for w, i in ranks.items()}
        self.bytes_of_decimal = {str(i): w for i, w in self.bytes_of.items()}
        self.kept = Kept(self)

    @classmethod
    @lru_cache(maxsize=2)  # Python workers live on from task to task
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def merged(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merging linked bytes: the heap holds the adjacent pairs that are tokens, by rank."""
        n, rank, push, pop = len(word), self.ranks.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged into the one before
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = pop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:  # a part has changed since
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    push(heap, (r, i, end[stop]))
            if i and (r := rank(word[(p := prev[i]) : stop])) is not None:
                push(heap, (r, p, stop))
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def ids(self, word: bytes) -> list[int]:
        slot = self.hash.find(word)
        return [self.id_of_slot[slot]] if slot >= 0 else self.merged(word)

    def joined(self, text: str) -> str:
        """The ids of ``text`` as decimals joined by commas."""
        return ",".join(map(self.kept.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [i for x in self.split.findall(text) for i in self.ids(x.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of_decimal.__getitem__, joined.split(","))) if joined else b""


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` -> ``doc_id, ids (array<int>), n_tokens, ids_sha256, decoded_sha256``, row by row, whole texts.

    ``vocabulary`` is the path of a rank file that every executor can read (installed software, not data).  A null text
    counts as empty: no ids.  Repeated rows, ties and extra columns change nothing; an empty table gives an empty result.
    The ids are decoded again, and the hash of the bytes is returned with them.  Without ``keep_ids`` there is no column
    of ids.
    """

    def make():  # noqa: ANN202
        codec = Codec.from_file(vocabulary, pattern)

        def run(texts: list) -> dict:
            out: dict[str, list] = {"ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                joined = codec.joined(text or "")
                out["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode_joined(joined)).hexdigest())
                if keep_ids:
                    out["ids"].append(list(map(int, joined.split(","))) if joined else [])
            return out

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    new = "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(rows, make, new, ["text"], ["doc_id"])
