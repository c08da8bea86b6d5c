"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of the id) and laid end to end; the line of words is cut into blocks of
equal length.  A golden-ratio sequence, mapped through the cumulative target shares, deals out slots to sources so that
every stretch of the schedule holds each source in proportion.  A source's k-th slot takes its k-th block, starting over
when the blocks are used up; its last slot is trimmed to the target.  Only DataFrame expressions are used.

Running sums (of words along a source, of slots of a source) go in two steps, inside buckets and then over the buckets'
totals, so a source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.arrow import hidden
from tidewatch.llm.store import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Words in a block.
BLOCK_WORDS = 4096
#: Buckets of a source's line; slots of the schedule that are counted together.
LINE_BUCKETS, SLOT_BUCKET = 512, 1024
#: Golden ratio as a fraction of 2**32; slot i stands at i * GOLDEN mod 2**32.
GOLDEN, CIRCLE, CELLS = 2654435769, 1 << 32, 1 << 12


def before(rows: DataFrame, group: str, bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of ``group`` that come earlier by (bucket, *order)."""
    rows = rows.withColumn("__value", value)
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(F.col(group).alias("__group"), F.col(bucket).alias("__bucket")).agg(F.sum("__value").alias("__total"))
        .withColumn("__offset", F.coalesce(F.sum("__total").over(along), F.lit(0)))
    )
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    joined = rows.join(totals, rows[group].eqNullSafe(totals["__group"]) & (rows[bucket] == totals["__bucket"]))
    return joined.withColumn(name, F.col("__inside") + F.col("__offset")).drop("__value", "__inside", "__group", "__bucket", "__total", "__offset")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """``sizes`` (source, size) -> one row per source: ``source, source_size, target``.

    The targets share ``share`` times all words by weight.  None is above ``most`` times its source; the excess goes to
    the others by weight, which comes to one common level per weight for all sources that are not full.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    table = F.array(*[F.lit(float(x)) for x in weights])
    ranked = ranked.withColumn("weight", F.element_at(table, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(every)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return leveled.select("source", "source_size", target.alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``sources`` (source, source_size, target) -> slots ``slot, source, rank, block, first, last``.

    ``first`` and ``last`` bound the words of the source that the slot takes.  Slots come in schedule order; the few
    that the sequence leaves out when it ends stand after it.
    """
    spark = sources.sparkSession
    whole = F.floor(F.col("target") + 0.5).cast("long")
    size, used = F.col("source_size"), F.col("words")
    src = (
        sources.where(size > 0).withColumn("words", whole)
        .withColumn("laps", F.floor(used / size).cast("long")).withColumn("rest", used - F.col("laps") * size)
        .withColumn("blocks", F.ceil(size / block).cast("long"))
        .withColumn("quota", F.col("laps") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
        .withColumn("upto", F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last())))
    )
    src = staged(src, "sources")
    n = src.agg(F.max("upto")).first()[0] or 0
    edge = lambda c: F.floor(c * F.lit(CIRCLE) / F.lit(max(n, 1))).cast("long")
    spans = src.select("source", "quota", edge(F.col("upto") - F.col("quota")).alias("lo"), edge(F.col("upto")).alias("hi"))
    width = CIRCLE // CELLS
    cells = spans.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    turned = lambda x: x * F.lit(GOLDEN) % F.lit(CIRCLE)  # noqa: E731  in halves, so that no product overflows
    low, high = F.col("id") % 65536, F.floor(F.col("id") / 65536) % 65536
    points = spark.range(n).select(F.col("id").alias("slot"), ((turned(high) * 65536 + turned(low)) % F.lit(CIRCLE)).alias("point"))
    dealt = points.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell").where("point >= lo AND point < hi")
    dealt = dealt.select("slot", "source", "quota", F.floor(F.col("slot") / SLOT_BUCKET).alias("bucket"))
    ranked = before(dealt, "source", "bucket", ["slot"], F.lit(1).cast("long"), "rank").where("rank < quota").select("slot", "source", "rank")
    ranked = staged(ranked, "slots")
    given = ranked.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("given"))
    late = (
        src.join(given, src["source"].eqNullSafe(given["s"]), "left").withColumn("given", F.coalesce("given", F.lit(0)))
        .where("given < quota").select("source", F.explode(F.expr("sequence(given, quota - 1)")).alias("rank"))
        .select((F.lit(n) + F.col("rank")).alias("slot"), "source", "rank")
    )
    lap = F.floor(F.col("rank") / F.col("blocks"))
    at = F.col("rank") % F.col("blocks")
    end = F.when(lap < F.col("laps"), size).otherwise(F.col("rest"))
    slots = ranked.unionAll(late).withColumnRenamed("source", "s").join(src, F.col("s").eqNullSafe(F.col("source")))
    return slots.select("slot", "source", "rank", at.alias("block"), (at * block).alias("first"), F.least(end, (at + 1) * block).alias("last"))


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rid_col: str | None = None) -> DataFrame:
    """Rows ``rid, doc_id, source, size, start``: where each document stands on its source's shuffled line of words.

    ``rid`` tells rows apart; it is a new number, or what the column ``rid_col`` of ``docs`` has.
    """
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    shuffled = F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("long")
    rows = docs.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), shuffled.alias("turn"))
    rows = staged(rows.withColumn("bucket", F.floor(F.col("turn") / ((1 << 48) // LINE_BUCKETS))), "sizes")
    return staged(before(rows, "source", "bucket", ["turn", "doc_id", "size", "rid"], F.col("size"), "start").drop("turn", "bucket"), "lines")


def dealt(lines: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """Every meeting of a document with a slot that takes one of its blocks: ``rid, start, end, slot, first, last``."""
    slots = schedule(sources, block).select(F.col("source").alias("s"), F.col("block").alias("b"), "slot", "first", "last")
    end = F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = lines.where("size > 0").select("rid", "source", "start", end.alias("end"), F.explode(blocks).alias("block"))
    return pieces.join(slots, pieces["source"].eqNullSafe(slots["s"]) & (pieces["block"] == slots["b"]))


def mixed(docs: DataFrame, block: int = BLOCK_WORDS, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, **cols: str) -> DataFrame:
    """What the mix takes of every document: ``rid, doc_id, source, size, start, source_size, target, taken, first_slot``.

    A null text has no words; a null source is a source of its own, last in order; rows repeated under one id are
    separate documents.  ``taken`` counts words, repeats included, and is at most ``most`` times the size (rounded up);
    ``first_slot`` is the slot of the schedule that first takes some of them.  Documents without words and empty tables
    take nothing (null slot).  Ties on a source's line go by id, then size; whole texts are counted, however long.
    Columns besides the three named ones are ignored, whatever their names.
    """
    lines = laid_out(docs, **cols)
    sources = staged(targets(lines.select("source", "size"), share, most, weights), "targets")
    words = F.least("end", "last") - F.greatest("start", "first")
    met = dealt(lines, sources, block).withColumn("words", words).where("words > 0")
    taken = met.groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    per = sources.withColumnRenamed("source", "s")
    out = lines.join(taken, "rid", "left").join(per, lines["source"].eqNullSafe(per["s"]), "left")
    taken = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    return out.select("rid", "doc_id", "source", "size", "start", "source_size", "target", taken, "first_slot")


def mix_documents(docs: DataFrame, block: int = BLOCK_WORDS, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """``docs`` as the mix has them, in whole documents, with unchanged columns and in the schedule's order.

    A document comes once for every slot that takes its first word, so zero times, once or (under the default cap) twice,
    and stands there by that slot.  Those without words come once, at the end.
    """
    rid, slot, start = hidden(docs, "rid", "slot", "start")
    held = staged(docs.select("*", F.monotonically_increasing_id().alias(rid)), "texts")
    lines = laid_out(held, rid_col=rid)
    sources = staged(targets(lines.select("source", "size"), share, most, weights), "targets")
    begun = dealt(lines, sources, block).where("start >= first AND start < last").select("rid", "slot", "start")
    seats = begun.unionAll(lines.where("size = 0").select("rid", F.lit(None).cast("long").alias("slot"), "start"))
    seats = staged(seats.select(F.col("rid").alias(rid), F.col("slot").alias(slot), F.col("start").alias(start)), "seats")
    return held.join(seats, rid).orderBy(F.col(slot).asc_nulls_last(), start, rid).select(*docs.columns)
