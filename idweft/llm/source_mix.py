"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every source is shuffled by a hash and cut evenly into blocks of its own count, so that its
target is worth LEAST_TARGET blocks or more, however small it is beside the others. Points of
the golden-ratio sequence fall into the sources' cumulative slots; the slots of a source are
ranked and take its blocks in turn, from the first again once all are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idweft.llm.storage import discard, written
from idweft.llm.words import WORD

WEIGHTS = (5, 2, 1)
#: Words of the mix over words of the documents, and the most times that a source is taken.
SHARE, MOST_TIMES = 1.5, 2
#: Slots: at least the first, this many for each source, and blocks of at most so many words.
LEAST_SLOTS, SLOTS_A_SOURCE, MOST_BLOCK = 1 << 16, 256, 1 << 20
#: Slots that a source's target is worth at least; the points miss that by two or three.
LEAST_TARGET = 512
GOLDEN = (math.sqrt(5) - 1) / 2
_BINS, _CHUNK = 4096, 4096
#: Sources up to which their steps are broadcast (a few hundred bytes each); more are joined.
MOST_BROADCAST = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """``source, place, source_size, target``: one row for each source, null last.

    Targets fill up by weight like connected vessels, each up to its own brim. With sources
    in the order in which they reach it, the level is known once the next brim lies above.
    The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_brim = Window.orderBy("brim", "place")
    before = by_brim.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most_times)))
        .withColumn("brim", F.col("cap") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("full")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("brim"), F.col("level"))).over(every))
        .select("source", "place", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))
    )


def cut(targets: DataFrame, block: int) -> DataFrame:
    """``targets`` with ``blocks``, the source's count of them, and ``slots``, how many of them make its target.

    Both are null where the target is 0. Blocks have at most ``block`` words. Where a target
    has fewer words than LEAST_TARGET, blocks outnumber words and some are empty; word p is
    in the block of its middle, (p + 1/2) * blocks / source_size, so empty ones lie between.
    """
    blocks = F.greatest(F.ceil(F.col("source_size") / F.lit(block)), F.ceil(F.lit(LEAST_TARGET) * F.col("source_size") / F.col("target")))
    some = F.col("target") > 0
    return targets.withColumn("blocks", F.when(some, blocks.cast("long"))).withColumn("slots", F.when(some, F.col("target") * F.col("blocks") / F.col("source_size")))


def schedule(spark, cuts: DataFrame, slots: int, most_times: int = MOST_TIMES) -> DataFrame:
    """``slot, place, turn, block_no``: which block of which source each slot takes.

    Slot k stands at frac((k + 1/2) * golden ratio). A slot whose source has been taken
    ``most_times`` already stays empty and is left out.
    """
    up_to = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        cuts.filter("slots > 0").withColumn("high", F.sum("slots").over(up_to) / F.sum("slots").over(Window.partitionBy()))
        .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0.0)))
        .withColumn("high", F.when(F.lead("high").over(Window.orderBy("place")).isNull(), F.lit(2.0)).otherwise(F.col("high")))
        .select("place", "low", "high", "blocks", F.explode(F.expr(f"sequence(int(floor(low * {_BINS})), least(int(floor(high * {_BINS})), {_BINS - 1}))")).alias("bin"))
    )
    point = spark.range(slots).withColumn("u", (F.col("id") + 0.5) * GOLDEN)
    point = point.withColumn("u", F.col("u") - F.floor("u")).withColumn("bin", F.floor(F.col("u") * _BINS).cast("int"))
    placed = point.join(ends, "bin").filter("u >= low and u < high").select(F.col("id").alias("slot"), F.expr(f"id div {_CHUNK}").alias("chunk"), "place", "blocks")
    counts = placed.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = placed.join(counts, ["place", "chunk"]).withColumn("rank", rank).filter(F.col("rank") < F.col("blocks") * most_times)
    return ranked.select("slot", "place", F.expr("rank div blocks").alias("turn"), (F.col("rank") % F.col("blocks")).alias("block_no"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """``id_col, source, size, source_size, target, taken, copies`` for every document.

    ``size`` is the words of the text (null: 0), ``taken`` the words that the mix takes, repeats
    counted: at most ``most_times`` each. ``copies`` is how often the block with the document's
    first word is taken (0 for a document without words), for mixes of whole documents.
    A null source is a source of its own. Tied and repeated rows each take a place of their
    own; equal rows are interchangeable, so reruns give the same rows. An empty table gives none.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).cast("long"), F.lit(0))
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(source_col).alias("source"), F.greatest(size, F.lit(0)).cast("long").alias("size"), key.alias("shuffled"))
    rows = written(rows, "sizes")
    targets = written(source_targets(rows, weights, share, most_times), "targets")
    n_sources, total = targets.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    slots = max(LEAST_SLOTS, SLOTS_A_SOURCE * n_sources, math.ceil(total / MOST_BLOCK))
    block = max(1, math.ceil(total / slots))
    cuts = written(cut(targets, block), "cuts")
    dealt = math.ceil(cuts.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0])
    turns = schedule(spark, cuts, dealt, most_times).groupBy("place", "block_no").agg(F.count("*").alias("times"))
    # two levels of running sums, so that a large source is not one window
    rows = rows.join(cuts.drop("slots").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("part", F.expr("shiftrightunsigned(shuffled, 52)"))
    parts = rows.groupBy("place", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("place", "part", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("place", "part").orderBy("shuffled", "doc_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.join(parts, ["place", "part"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = ["doc_key", "source", "size", "source_size", "target"]
    # decimals, as the product of a word's place and the blocks may pass 64 bits
    holder = "(cast(2 * ({}) + 1 as decimal(19, 0)) * blocks) div (2 * source_size)"
    first_word = "cast((cast(2 * ({}) as decimal(19, 0)) * source_size + blocks - 1) div (2 * blocks) as long)"
    pieces = laid.filter("size > 0").select(*own, "place", "start", "blocks", F.explode(F.expr(f"sequence({holder.format('start')}, {holder.format('start + size - 1')})")).alias("block_no"))
    words = F.expr(f"least(start + size, {first_word.format('block_no + 1')}) - greatest(start, {first_word.format('block_no')})")
    times = F.coalesce(F.col("times"), F.lit(0))
    taken = (
        pieces.join(turns, ["place", "block_no"], "left").groupBy("place", "start", *own)
        .agg(F.sum(words * times).alias("taken"), F.min_by(times, "block_no").alias("copies"))
        .select(*own, "taken", "copies")
    )
    none = laid.filter("size = 0").select(*own, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    return taken.unionByName(none).withColumnRenamed("doc_key", id_col)


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies_col: str = "copies", seed: int = 7, **how) -> DataFrame:
    """Every row of ``docs`` with the copies that :func:`mix` gives it, without moving the texts.

    A source's blocks stand in the order of its rows' hashes, and those that are taken once
    more than the others come first. So a source's copies are a few steps along the hash,
    which a row looks up by its own. Rows that share a hash, as those of one id do, get the
    copies of the last of them. ``how`` is passed on to :func:`mix`.
    """
    key = lambda col: F.xxhash64(F.col(col).cast("string"), F.lit(seed)).bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  the unsigned order
    mixed = mix(docs, id_col, text_col, source_col, seed=seed, **how).filter("size > 0").select("source", key(id_col).alias("at"), F.col("copies").cast("int").alias("copies"))
    mixed = mixed.groupBy("source", "at").agg(F.max("copies").alias("copies")).withColumn("part", F.shiftright("at", 52))
    # changes inside a part of the hashes, then between parts
    inside, parts = Window.partitionBy("source", "part").orderBy("at"), Window.partitionBy("source").orderBy("part")
    marks = mixed.withColumn("before", F.lag("copies").over(inside)).withColumn("next", F.lead("copies").over(inside)).filter("before is null or next is null or before <> copies")
    ends = written(marks, "step_marks")
    last = ends.filter("next is null").select("source", "part", F.lag("copies").over(parts).alias("earlier"))
    steps = ends.join(last.withColumnsRenamed({"source": "of", "part": "of_part"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    steps = steps.withColumn("before", F.coalesce("before", "earlier")).filter("before is null or before <> copies")
    steps = written(steps.groupBy(F.col("source").alias("mixed_source")).agg(F.array_sort(F.collect_list(F.struct("at", "copies"))).alias("steps")), "steps")
    discard(ends)
    if steps.count() <= MOST_BROADCAST:
        steps = F.broadcast(steps)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source_col).alias("own_source"), key(id_col).alias("own_key"), F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)).alias("has_words"))
    joined = rows.join(steps, F.col("own_source").eqNullSafe(F.col("mixed_source")), "left")
    reached = F.filter("steps", lambda step: step["at"] <= F.col("own_key"))
    copies = F.when(F.col("has_words") & (F.size(reached) > 0), F.element_at(reached, -1)["copies"]).otherwise(F.lit(0))
    joined = joined.select("doc", F.coalesce(copies, F.lit(0)).alias("row_copies"))  # before the fields, whose names may be those above
    return joined.select("doc.*", F.col("row_copies").alias(copies_col))
