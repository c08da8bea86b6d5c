"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch are inserted in a trie.  Walking it once, the forward score of a node (the best score
of any segmentation of the prefix it stands for, and that segmentation's number of tokens) is computed from its
ancestors' scores only, so prefixes that pre-tokens share are computed once.  Where a pre-token ends, the count is kept.
"""

from __future__ import annotations

import math
from functools import lru_cache

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrow import map_rows

#: Pre-tokens whose counts a task keeps; the table starts afresh when it is full.
KEPT = 1_000_000
#: Code points of the longest pre-token that goes into the trie.
LONGEST = 200
#: What begins a word in the vocabulary.
MARK = "▁"
#: Log-probability of a byte where no piece fits, relative to the least likely piece.
BYTE_PENALTY = 10.0


class Unigram:
    """Pieces with log-probabilities.  A code point that is no piece costs its UTF-8 bytes, a token each."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - BYTE_PENALTY
        self.tails = {p[k:] for p in pieces for k in range(len(p))}  # what a piece can end in
        self.kept: dict[str, int] = {}

    @classmethod
    @lru_cache(maxsize=2)  # Python workers live on from task to task
    def from_file(cls, path: str) -> Unigram:
        """Vocabulary of a SentencePiece file with its scores as log-probabilities.  Where the scores are whole numbers they are
        no probabilities but the ranks of merges; the log-probability then is Zipf's, minus the logarithm of the rank,
        normalised over the vocabulary."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = [model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(x != int(x) for x in scores):
            return cls(dict(zip(names, scores, strict=True)))
        total = math.log(sum(1 / (k + 1) for k in range(len(names))))
        return cls({p: -math.log(k + 1) - total for k, p in enumerate(names)})

    def step(self, path: list[str], scores: list[float], counts: list[int], end: int) -> tuple[float, int]:
        """Best score and its count for the prefix ``path[:end]``, from those of all shorter prefixes."""
        best, n = scores[end - 1] + self.byte * (w := len(path[end - 1].encode("utf-8", "surrogatepass"))), counts[end - 1] + w
        get, tails, tail = self.pieces.get, self.tails, ""
        for at in range(end - 1, -1, -1):
            tail = path[at] + tail
            if tail not in tails:
                break
            p = get(tail)
            if p is not None:
                s = scores[at] + p
                if s > best + 1e-12 or s > best - 1e-12 and counts[at] + 1 < n:
                    best, n = s, counts[at] + 1
        return best, n

    def count_long(self, word: str) -> int:
        """Count of a word too long for the trie, with the states of its last code points only."""
        path, scores, counts = [], [0.0], [0]
        for c in word:
            path.append(c)
            s, n = self.step(path, scores, counts, len(path))
            scores.append(s)
            counts.append(n)
            if len(path) > 4 * self.longest:
                low = scores[-self.longest - 1]  # scores matter by their differences
                path, scores, counts = path[-self.longest :], [x - low for x in scores[-self.longest - 1 :]], counts[-self.longest - 1 :]
        return counts[-1]

    def learn(self, words: set[str]) -> None:
        """Counts of ``words`` into the table, by one walk over their trie."""
        if len(self.kept) + len(words) > KEPT:
            self.kept.clear()
        root: dict = {}
        for word in words:
            node = root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word
        path: list[str] = []
        scores, counts = [0.0], [0]
        todo: list[tuple[int, str, dict]] = [(0, "", root)]
        while todo:
            depth, c, node = todo.pop()
            if depth:
                del path[depth - 1 :], scores[depth:], counts[depth:]
                path.append(c)
                s, n = self.step(path, scores, counts, depth)
                scores.append(s)
                counts.append(n)
            for c, below in node.items():
                if c:
                    todo.append((depth + 1, c, below))
                else:
                    self.kept[below] = counts[depth]

    def count_all(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        split = [(t or "").split() for t in texts]
        new = {w for words in split for w in words} - self.kept.keys()
        if new:
            if len(self.kept) + len(new) > KEPT:
                new = {w for words in split for w in words}
            # a pre-token bears the mark of its beginning
            self.learn({MARK + w for w in new if len(w) <= LONGEST})
            for w in new:
                self.kept[w] = self.kept.pop(MARK + w) if len(w) <= LONGEST else self.count_long(MARK + w)
        kept = self.kept.__getitem__
        return [sum(map(kept, words)) for words in split], [len(words) for words in split]


def counted(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> ``doc_id, n_pre_tokens, n_tokens``, row by row, whole texts.

    Pre-tokens are runs without white space.  ``vocabulary`` is the path of a SentencePiece file that every executor can
    read (installed software, not data).  A null, empty or blank text has no tokens.  Of segmentations with equal scores
    the one of fewest tokens counts.  Repeated rows, ties and extra columns change nothing; an empty table gives an
    empty result.
    """

    def make():  # noqa: ANN202
        unigram = Unigram.from_file(vocabulary)

        def run(texts: list) -> dict:
            tokens, pre = unigram.count_all(texts)
            return {"n_pre_tokens": pre, "n_tokens": tokens}

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "n_pre_tokens long, n_tokens long", ["text"], ["doc_id"])
