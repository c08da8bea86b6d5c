"""N-gram Jaccard join by parity sketches.

A document is the set of its word n-grams.  For a band of set sizes, the n-grams are dealt by hash over P parts, and each
is XORed into its part as a hash of 32 bits: a sketch of P words, every bit of which is a parity.  An n-gram that only one
of two documents has changes one part, so the number of parts in which two sketches differ is at most the sets' symmetric
difference.  Linked documents of sizes a and b differ in at most (1 - t) / (1 + t) * (a + b) n-grams; a band has some parts
more than that for its largest sizes.  So linked documents agree in a part (pigeonhole), and the join on equal parts finds
every pair.  They agree in ``need`` parts at least, so each document may leave out its ``need`` - 1 commonest parts: of the
parts that two linked documents share, the rarest is then left in both.  Parts of common lines drop out by that, and
documents that share fewer parts than ``need`` with all others.  A second sketch has one parity bit flipped by each n-gram: the Hamming distance of two of these bounds the
symmetric difference from below and rejects pairs; at last the texts decide.

Equal sets are one node from the start.  For components, the nodes that share a part are first compared with one of them,
the one that shares most parts with others, and then with the one that does so of those left over.  Only what such stars
leave apart is joined pair by pair, and there the nodes of a part's largest component are not compared with each other.
The bound is part of the join's condition, so pairs that it tells apart never leave the join.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.arrow import map_rows
from tidewatch.llm.links import components
from tidewatch.llm.store import drop, staged

#: Words of a shingle; similarity that links, in hundredths.
WORDS, SIMILAR = 3, 90
#: Ratio of the sizes that bound a band.
BAND = 1.3
#: Nodes of a part that meet the rest of it in one task at most.
BLOCK = 2048
#: Times that a part's nodes are compared with one of them before pairs are.
STARS = 2
#: Parts that a band has beyond need, in hundredths, so that parts of no bits need not be joined on.
SPARE = 15
#: Passes over the sketches, each with its share of the parts, so that shuffles of all parts never lie on disk at once.
PASSES = 4
#: Rows with parity bits that one pass of the join pair by pair moves: one for so many n-grams of the corpus, and so many at least.
SHARE, LEAST = 64, 1 << 20
#: Words of the sketch of parity bits that bounds are taken from.
FOLD = 16
#: Bytes of the words whose hashes a task keeps.
KEPT = 40_000_000


def bands(largest: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


EDGES = bands()


def differ(total: int, similar: int) -> int:
    """The most n-grams by which linked sets of ``total`` elements together differ."""
    return total * (100 - similar) // (100 + similar)


def entries(n: int, similar: int) -> list[tuple[int, int, int]]:
    """(band, parts, most n-grams that differ) of the joins that a set of size ``n`` takes part in: its own band's, and as the larger of a pair
    that of the band below, if sizes there can link to it."""
    own = bisect_right(EDGES, n) - 1
    found = []
    for k in (own, own - 1):
        if k >= 0 and (k == own or n <= (EDGES[own] - 1) * 100 // similar):
            a = EDGES[k + 1] - 1
            if (most := differ(a + a * 100 // similar, similar)) > 0:
                found.append((k, most + 1 + -(-SPARE * (most + 1) // 100), most))
    return found


class Hashes(dict):
    """Hashes of words; fills itself, and starts afresh when the words take too many bytes."""

    room = KEPT

    def __missing__(self, word: bytes) -> int:
        self.room -= len(word) + 120
        if self.room < 0:
            self.clear()
            self.room = KEPT
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but ASCII white space, A-Z lower-cased (which is what bytes methods do)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], kept: Hashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(hashes: np.ndarray, parts: int) -> np.ndarray:
    """XOR of 32 bits of the hashes in each of ``parts`` parts."""
    part = (hashes >> np.uint64(10)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    out = np.zeros(parts, np.uint32)
    out[part[first]] = np.bitwise_xor.reduceat((hashes >> np.uint64(32)).astype(np.uint32)[order], first)
    return out.view(np.int32)


def parities(hashes: np.ndarray) -> np.ndarray:
    """``FOLD`` words of bits; each hash flips one."""
    times = np.bincount((hashes % np.uint64(64 * FOLD)).astype(np.int64), minlength=64 * FOLD)
    return np.packbits((times & 1).astype(np.uint8)).view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int, similar: int) -> DataFrame:
    """Rows ``doc_id, n, print, fold, sketches``: set size, 128-bit fingerprint of the set, its parity bits, one sketch per join."""

    def make():  # noqa: ANN202
        kept = Hashes()

        def run(texts: list) -> dict:
            out: dict[str, list] = {"n": [], "print": [], "fold": [], "sketches": []}
            for text in texts:
                h = shingles(words_of(text), kept, size)
                out["n"].append(len(h))
                out["print"].append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                found = [(k, sketch(h, p), d) for k, p, d in entries(len(h), similar)] if len(h) else []
                out["fold"].append(parities(h) if found else None)
                # an empty part tells nothing; with more other parts than can differ, a partner agrees in the surplus of those
                surplus = [int((x != 0).sum()) - d for _, x, d in found]
                out["sketches"].append([{"band": k, "parts": x, "zeros": m <= 0, "need": max(1, m)} for (k, x, _), m in zip(found, surplus, strict=True)])
            return out

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "n long, print binary, fold array<long>, sketches array<struct<band: int, parts: array<int>, zeros: boolean, need: int>>", ["text"], ["doc_id"])


def slimmed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes without their sketches, and what bounds need of these (node, n, fold); the whole is deleted."""
    slim = staged(nodes.select("node", "print", "doc_id", "n"), "nodes")
    bounds = staged(nodes.where("fold IS NOT NULL").select("node", F.col("n").cast("int").alias("n"), "fold"), "bounds")
    drop(nodes)
    return slim, bounds


def several_have(keyed: DataFrame) -> DataFrame:
    """Staged rows of ``keyed`` whose ``key`` comes more than once, with ``members``: how often."""
    several = staged(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "several", large=True)
    out = staged(keyed.join(several, "key"), "shared", large=True)
    drop(several)
    return out


def shared_parts(nodes: DataFrame) -> DataFrame:
    """Staged ``node, n, key, members, known, root``: the parts of sketches that several nodes have, without the ``need`` - 1
    commonest of each sketch; how many have each, and the sum of that over the node's parts; every node is its own root."""
    # a sketch's number: a node takes part in two joins at most
    keyed = nodes.select("node", F.posexplode("sketches").alias("which", "s")).select((F.col("node") * 2 + F.col("which")).alias("entry"), "s.*")
    keyed = keyed.select("entry", "band", "zeros", F.posexplode("parts").alias("pos", "part"))
    keyed = keyed.where("zeros OR part != 0").select("entry", F.xxhash64("band", "pos", "part").alias("key"))
    found = [several_have(keyed.where(F.pmod("key", F.lit(PASSES)) == turn)) for turn in range(PASSES)]
    needs = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("sketches.need").alias("which", "need"))
    needs = needs.select((F.col("node") * 2 + F.col("which")).alias("entry"), "node", "n", "need")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    ranked = every.join(needs, "entry").withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("members"), "key")))
    rare = staged(ranked.where("rank >= need").select("node", "n", "key"), "rare", large=True)
    for x in found:
        drop(x)
    shared = several_have(rare)
    drop(rare)
    known = shared.groupBy("node").agg(F.sum("members").alias("known"))
    out = staged(shared.join(known, "node").withColumn("root", F.col("node")), "known", large=True)
    drop(shared)
    return out


def allowed(similar: int) -> Column:
    """Whether sizes and the Hamming distance of the parity bits of ``a`` and ``b`` allow a link."""
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similar
    far = sum((F.bit_count(F.col("fold_a")[i].bitwiseXOR(F.col("fold_b")[i])) for i in range(FOLD)), F.lit(0))
    return fits & (far * (100 + similar) <= (F.col("n_a") + F.col("n_b")) * (100 - similar))


def side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select(*more, F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fold").alias(f"fold_{x}"))


def within_bounds(pairs: DataFrame, bounds: DataFrame, similar: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that no bound tells apart."""
    met = pairs.join(side(bounds, "a"), "a").join(side(bounds, "b"), "b")
    return met.where(allowed(similar)).select("a", "b").distinct()


def candidates(shared: DataFrame, bounds: DataFrame, similar: int, every: bool = False) -> DataFrame:
    """``shared`` (node, n, key, members, root) -> distinct pairs (a, b), a < b, of different roots that share a part
    and that no bound tells apart; with ``every``, of different nodes.

    Under each part, the nodes of its largest root meet only the others.  A part's nodes are dealt over blocks, and those
    outside the largest root go to every block, so that no task gets a large part alone.  Blocks are joined in passes, as
    many as it takes to bound what a pass moves.
    """
    rows = shared.select("key", "node", "members", "root")
    if every:
        rows = rows.withColumn("largest", F.lit(None).cast("long"))
    else:
        roots = shared.groupBy("key", "root").agg(F.count("*").alias("times")).groupBy("key").agg(F.max_by("root", F.struct("times", "root")).alias("largest"))
        rows = rows.join(roots, "key")
    rows = rows.select("key", "node", "root", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.col("root").eqNullSafe(F.col("largest")).alias("inside"))
    rows = staged(rows, "rows", large=True)
    moved = rows.agg(F.sum(F.when(F.col("inside"), 1).otherwise(F.col("blocks") + 1))).first()[0] or 0
    passes = max(1, -(-moved // max(LEAST, (bounds.agg(F.sum("n")).first()[0] or 0) // SHARE)))
    every_block = rows.where(~F.col("inside")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own_block = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    told = (F.col("a") != F.col("b")) if every else (F.col("root_a") != F.col("root_b"))
    found = None
    for turn in range(passes):
        now = F.pmod(F.xxhash64("key", "block"), F.lit(passes)) == turn
        one = side(every_block.where(now).join(bounds, "node"), "a", "key", "block", F.col("root").alias("root_a"))
        two = side(own_block.where(now).join(bounds, "node"), "b", "key", "block", F.col("root").alias("root_b"), "inside")
        met = one.join(two, (one["key"] == two["key"]) & (one["block"] == two["block"]) & told & (F.col("inside") | (F.col("a") < F.col("b"))) & allowed(similar))
        met = staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met", large=True)
        found = met if found is None else found.unionAll(met)
    drop(rows)
    return found.distinct()


def star(shared: DataFrame, bounds: DataFrame, similar: int, first: bool) -> DataFrame:
    """``shared`` (node, n, key, known, root) -> pairs (a, b) that no bound tells apart: each node with the one that it
    meets most often among its parts' centres.

    A part's centre is the node that is known best; after the first time, the one of those outside its largest root.
    """
    if first:
        able = shared
    else:
        roots = shared.groupBy("key", "root").agg(F.count("*").alias("times")).groupBy("key").agg(F.max_by("root", F.struct("times", "root")).alias("largest"))
        able = shared.join(roots, "key").where("root != largest")
    middle = able.groupBy("key").agg(F.max(F.struct("known", "n", "node", "root")).alias("m"))
    fits = F.least("n", "m.n") * 100 >= F.greatest("n", "m.n") * similar
    met = shared.join(middle, "key").where((F.col("root") != F.col("m.root")) & fits)
    met = met.groupBy("node", F.col("m.node").alias("centre")).agg(F.count("*").alias("times"))
    met = met.groupBy("node").agg(F.max_by("centre", F.struct("times", "centre")).alias("centre"))
    met = met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    return staged(within_bounds(staged(met, "met", large=True), bounds, similar), "star", large=True)


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, unique: bool) -> DataFrame:
    """``node, text`` of the nodes in ``wanted``, staged.  The corpus is read once more; only wanted texts are kept."""
    wanted = staged(wanted.distinct().join(nodes.select("node", F.col("doc_id").alias("i"), F.col("print").alias("p")), "node"), "wanted")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if unique:
        return staged(rows.join(wanted.select("i", "node"), rows["doc_id"].eqNullSafe(wanted["i"])).select("node", "text"), "texts", large=True)

    def make():  # noqa: ANN202
        held = Hashes()

        def run(values: list) -> dict:
            return {"print": [hashlib.blake2b(shingles(words_of(t), held, size).tobytes(), digest_size=16).digest() for t in values]}

        return run

    # an id may stand for rows of different texts: the fingerprint says which is meant
    ids = staged(wanted.select("i").distinct(), "ids")
    rows = rows.join(ids, rows["doc_id"].eqNullSafe(ids["i"]), "left_semi")
    texts = map_rows(rows.withColumn("copy", F.col("text")), make, "print binary", ["text"], ["doc_id", "copy"])
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["i"]) & (texts["print"] == wanted["p"]))
    return staged(texts.select("node", F.col("copy").alias("text")).dropDuplicates(["node"]), "texts", large=True)


def verified(pairs: DataFrame, texts: DataFrame, size: int, similar: int) -> DataFrame:
    """The pairs whose texts' n-gram sets are similar enough, counted exactly on the n-grams themselves."""
    joined = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def similar_sets(first: list, second: list) -> dict:
        out = []
        for x, y in zip(first, second, strict=True):
            s, t = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (words_of(x), words_of(y)))
            both = len(s & t)
            out.append(100 * both >= similar * (len(s) + len(t) - both))
        return {"linked": out}

    linked = map_rows(joined, lambda: similar_sets, "linked boolean", ["text_a", "text_b"], ["a", "b"])
    return linked.where("linked").select("a", "b")


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int, similar: int) -> tuple[DataFrame, DataFrame, bool]:
    """Staged rows (doc_id, n, print) and nodes (node, print, doc_id, n, sketches), one per distinct non-empty set; and
    whether every id is one row's own."""
    first = staged(sketched(docs, id_col, text_col, size, similar), "sketched")
    rows = staged(first.select("doc_id", "n", "print"), "sets")
    nodes = first.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("fold").alias("fold"), F.first("sketches").alias("sketches"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", large=True)
    drop(first)
    return rows, nodes, not rows.groupBy("doc_id").count().where("count > 1").take(1)


def every_link(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, similar: int, unique: bool) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between nodes; and the nodes without their sketches, for ``nodes`` is deleted."""
    shared = shared_parts(nodes)
    nodes, bounds = slimmed(nodes)
    pairs = staged(candidates(shared, bounds, similar, every=True), "pairs", large=True)
    texts = texts_of(both_ends(pairs), nodes, docs, id_col, text_col, size, unique)
    return staged(verified(pairs, texts, size, similar), "linked", large=True), nodes


def spanning_links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, similar: int, unique: bool) -> tuple[DataFrame, DataFrame]:
    """Links enough to connect whatever links connect; and the nodes without their sketches, for ``nodes`` is deleted.

    Stars come first, and after each the parts whose nodes are all in one component are done with; then, in the parts
    whose nodes still fall into several components, all pairs across components are compared.  A large group of near
    copies is mostly connected by then, and its pairs are never listed.
    """
    shared = shared_parts(nodes)
    nodes, bounds = slimmed(nodes)
    links = None
    for turn in range(STARS + 1):
        pairs = star(shared, bounds, similar, turn == 0) if turn < STARS else staged(candidates(shared, bounds, similar), "pairs", large=True)
        texts = texts_of(both_ends(pairs), nodes, docs, id_col, text_col, size, unique)
        new = staged(verified(pairs, texts, size, similar), "linked", large=True)
        drop(texts)
        links = new if links is None else links.unionAll(new)
        if turn < STARS:
            rooted = shared.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
            before, shared = shared, staged(rooted.join(mixed, "key", "left_semi"), "mixed", large=True)
            drop(before)
    drop(shared)
    return links, nodes


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similar: int = SIMILAR, count_links: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` and, if counted, ``n_links``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; the set holds the distinct shingles of
    ``size`` words, or the whole sequence if there are fewer.  Two documents are linked when their sets' Jaccard
    similarity is ``similar`` hundredths or more; ``component_id`` is the smallest id reachable by links.  A null, empty
    or blank text has an empty set and is linked with nothing.  ``n_links`` counts the links of the row's set with
    different sets, leaving out its equals; without it, links inside what is connected already need not be listed.  Repeated rows have equal sets; a null id is never the smallest.  Sets are
    told apart by 128-bit fingerprints and counted by 64-bit shingle hashes; links are decided on the shingles.
    """
    rows, nodes, unique = sets_of(docs, id_col, text_col, size, similar)
    links, nodes = (every_link if count_links else spanning_links)(nodes, docs, id_col, text_col, size, similar, unique)
    roots = components(links)
    least = nodes.select("node", "doc_id")
    named = staged(roots.join(least, "node"), "roots")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    degree = both_ends(links).groupBy("node").agg(F.count("*").alias("n_links"))
    named = named.select("node", "root").join(smallest, "root").join(degree, "node").select("node", "component_id", "n_links")
    sets = nodes.select("print", "node", F.col("doc_id").alias("least")).join(named, "node", "left")
    sets = sets.select(F.col("print").alias("p"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.join(sets, (rows["print"] == sets["p"]) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    links_of = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *links_of)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similar: int = 80) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each group that links connect, the row with the smallest id stays.

    Columns are as they were.  Rows with an empty set stay; where rows repeat under the smallest id, one stays.
    """
    rows, nodes, unique = sets_of(docs, id_col, text_col, size, similar)
    links, nodes = spanning_links(nodes, docs, id_col, text_col, size, similar, unique)
    roots = components(links)
    named = staged(roots.join(nodes.select("node", "doc_id", "print"), "node"), "roots")
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    goes = named.join(least, "root").where("node != least.node").select("print")
    stay = rows.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id")).join(goes, "print", "left_anti")
    gone = rows.where("n > 0").join(stay, rows["print"].eqNullSafe(stay["print"]) & rows["doc_id"].eqNullSafe(stay["doc_id"]), "left_anti")
    if unique:
        gone = staged(gone.select(F.col("doc_id").alias("__i")), "gone")
        return docs.join(gone, docs[id_col].eqNullSafe(gone["__i"]), "left_anti").select(*docs.columns)
    return drop_by_print(docs, stay, id_col, text_col, size)


def drop_by_print(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """As above for tables in which an id is not a row's own: rows are told apart by id and fingerprint."""

    def make():  # noqa: ANN202
        held = Hashes()

        def run(values: list) -> dict:
            sets = [shingles(words_of(t), held, size) for t in values]
            return {"print": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], "empty": [not len(h) for h in sets]}

        return run

    cols = [F.col(c).alias(f"_{c}") for c in docs.columns]
    rows = map_rows(docs.select(*cols, F.col(text_col).alias("text")), make, "print binary, empty boolean", ["text"], [f"_{c}" for c in docs.columns])
    stay = stay.withColumnsRenamed({"doc_id": "i", "print": "p"})
    kept = rows.where(~F.col("empty")).join(stay, rows[f"_{id_col}"].eqNullSafe(stay["i"]) & (rows["print"] == stay["p"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy(f"_{id_col}", "print").orderBy(F.lit(0)))
    kept = kept.withColumn("turn", turn).where("turn = 1").drop("turn").unionAll(rows.where("empty"))
    return kept.select([F.col(f"_{c}").alias(c) for c in docs.columns])
