"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of code points.  The distinct blocks are sorted and get integer names; then
adjacent pairs of names are sorted and named in turn, level by level, until each document is down to one name.  Names
are handed out by rank, never by hash, so two documents share a name if and only if their texts are equal.

Everything runs as DataFrame expressions.  The distinct blocks are sorted within the partitions of one shuffle (a name is
the partition's number in the high bits, the rank below), so there is no global sort.  Rows find their names by a 64-bit
key of the block; where two different blocks share a key, which is counted, those rows are joined by the whole block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrow import hidden
from tidewatch.llm.store import staged

#: Code points in a block of the first level.
BLOCK = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased, nothing else touched."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def blocks_of(text: Column, size: int) -> Column:
    """Array of the text's blocks; an empty text has one empty block."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def name_values(rows: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """The staged ``rows`` (id, sha, n, pos, key) with ``name`` for their key: equal values (key, *cols), equal names.

    ``values`` has the rows once more with what is named, and is only read again where different values share a key.
    Distinct values are found with map-side aggregation, so a value that a third of all rows hold does not gather in one
    task; rows come to their names by an equi-join that adaptive execution may split.
    """
    distinct = values.select("key", *cols).distinct().sortWithinPartitions(*cols)
    names = staged(distinct.select("key", (F.monotonically_increasing_id() + 1).alias("name")), "names", large=True)
    clash = names.groupBy("key").count().where("count > 1").select("key")
    if not clash.take(1):
        return rows.join(names, "key").select("id", "sha", "n", "pos", "name")
    clash = staged(clash, "clashes")
    apart = values.join(clash, "key", "left_semi").select("key", *cols).distinct().sortWithinPartitions(*cols)
    exact = staged(apart.select(F.col("key").alias("key_of"), *[F.col(c).alias(f"{c}_of") for c in cols], (-F.monotonically_increasing_id() - 1).alias("name")), "names")
    same = [F.col("key") == F.col("key_of")] + [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in cols]
    alone = rows.join(names.join(clash, "key", "left_anti"), "key").select("id", "sha", "n", "pos", "name")
    return alone.unionAll(values.join(exact, same).select("id", "sha", "n", "pos", "name").distinct())


def blocks(docs: DataFrame, block: int, key: Column | None) -> DataFrame:
    """``docs`` (id, sha, text_sha, text) -> its blocks ``id, sha, text_sha, n, pos, block, key``."""
    rows = docs.select("id", "sha", "text_sha", blocks_of(F.col("text"), block).alias("blocks"))
    rows = rows.select("id", "sha", "text_sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    rows = rows.withColumn("block", normalised(F.col("block")))  # letter by letter, so it may follow the cutting
    return rows.withColumn("key", F.xxhash64("block") if key is None else key)


def identities(docs: DataFrame, block: int = BLOCK, key: Column | None = None) -> DataFrame:
    """``docs`` (id, sha, text_sha, text) -> (id, sha, text_sha, times, level, name); rows agree in (level, name) exactly when
    their normalised texts are equal.

    ``sha`` only tells rows apart that share an id; rows that agree in both come out once, with their number.
    """
    rows = blocks(docs, block, key)
    keyed = staged(rows.drop("block"), "keyed", large=True)
    times = keyed.where("pos = 0").groupBy("id", "sha").agg(F.count("*").alias("times"), F.first("text_sha").alias("text_sha"))
    named, level, done = staged(name_values(keyed.select("id", "sha", "n", "pos", "key"), rows, ["block"]), "level", large=True), 0, None
    while True:
        ended = named.where("n = 1").select("id", "sha", F.lit(level).alias("level"), "name").distinct()
        done = ended if done is None else done.unionAll(ended)
        rest = named.where("n > 1")
        if not rest.take(1):
            break
        odd = F.col("pos") % 2 == 1
        pairs = (
            rest.groupBy("id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"))
            .withColumn("b", F.coalesce("b", F.lit(0).cast("long"))).withColumn("key", F.xxhash64("a", "b"))
        )
        pairs = staged(pairs, "pairs")
        named, level = staged(name_values(pairs.select("id", "sha", "n", "pos", "key"), pairs, ["a", "b"]), "level"), level + 1
    done = staged(done, "identities").withColumnsRenamed({"id": "i", "sha": "s"})
    return times.join(done, times["id"].eqNullSafe(done["i"]) & (times["sha"] == done["s"])).drop("i", "s")


def sha_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def grouped(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """One row per distinct (id, sha): how often it comes (times), its group's size and which (id, sha) stays (best)."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), sha_of(text).alias("sha"), sha_of(normalised(text)).alias("text_sha"), text.alias("text"))
    named = staged(identities(rows, block), "named", large=True)
    groups = named.groupBy("level", "name").agg(F.max(F.struct("id", "sha")).alias("best"), F.sum("times").alias("group_size"))
    return named.join(groups, ["level", "name"])


STAYS = "id <=> best.id AND sha = best.sha"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Every row of ``docs`` with the row that stays for it.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.  Texts are compared whole, however
    long, after lower-casing A-Z; a null text counts as empty.  The largest id of a group stays; where a row comes
    repeatedly under that id, one of the repeats is marked kept.  A null id sorts below all others.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    rows = grouped(docs, id_col, text_col, block).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    kept = F.expr(STAYS) & (F.col("turn") == 1)
    return rows.select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("text_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay (largest id of each group of equal texts), all columns as they were.

    Where a row that stays comes repeatedly with one id and one text, one of the repeats stays; only such rows are
    gathered for that.
    """
    stay = staged(grouped(docs, id_col, text_col, block).where(STAYS).select("id", "sha", "times"), "stay")
    sha, i, s = hidden(docs, "sha", "id_of", "sha_of")
    rows = docs.withColumn(sha, sha_of(F.col(text_col)))

    def those(which: str) -> DataFrame:
        few = stay.where(which).select(F.col("id").alias(i), F.col("sha").alias(s))
        return rows.join(few, rows[id_col].eqNullSafe(few[i]) & (rows[sha] == few[s]), "left_semi")

    if not stay.where("times > 1").take(1):
        return those("true").select(*docs.columns)
    return those("times = 1").unionAll(those("times > 1").dropDuplicates([id_col, sha])).select(*docs.columns)
