"""Mixing sources to target weights by proportionate-fair scheduling, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruleweave.llm.common import cut, free

#: Slots of one frame: target weights are rounded to this many parts, at least one part per source.
FRAME = 512


def tempered(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """(source, weight): weights proportional to the number of documents raised to ``power``."""
    return docs.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("weight"))


def _quotas(ids: DataFrame, weights: DataFrame, frame: int) -> DataFrame:
    """(source, n, q): documents of each source and its slots in a full frame."""
    counts = ids.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    usable = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(0.0)
    asked = weights.select(F.col("source").cast("string").alias("_source"), usable.alias("weight")).groupBy("_source").agg(F.sum("weight").alias("weight"))
    both = counts.join(asked, counts["source"].eqNullSafe(asked["_source"]), "left")
    both = both.select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    share = F.round(F.col("weight") * frame / F.when(F.col("total") > 0, F.col("total")))
    rows = both.groupBy().agg(F.collect_list(F.struct("source", "n", "weight")).alias("all"), F.sum("weight").alias("total"))
    return rows.select(F.inline("all"), "total").select("source", "n", F.greatest(F.lit(1), F.coalesce(share, F.lit(1)).cast("long")).alias("q"))


def _segments(quotas: DataFrame) -> DataFrame:
    """Runs of frames with equal make-up: (first, stop, base, size, parts).

    Source i fills its quota in the first n div q frames, has n mod q documents in the next one and
    none later, so the make-up changes at most twice per source. ``parts`` lists (source, c).
    """
    one = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "n", "q"))).alias("s"))
    full = F.transform("s", lambda x: F.floor(x["n"] / x["q"]))
    marks = F.concat(F.array(F.lit(0).cast("long")), full, F.transform(full, lambda f: f + 1))
    one = one.withColumn("marks", F.array_sort(F.array_distinct(marks)))
    rows = one.select("s", "marks", F.posexplode("marks").alias("k", "first"))
    rows = rows.withColumn("stop", F.try_element_at("marks", F.col("k") + 2))

    def amount(x: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(x["q"], x["n"] - F.col("first") * x["q"]))

    parts = F.filter(F.transform("s", lambda x: F.struct(x["source"].alias("source"), amount(x).alias("c"))), lambda p: p["c"] > 0)
    rows = rows.select("first", "stop", parts.alias("parts")).filter("stop IS NOT NULL AND size(parts) > 0")
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["c"])
    rows = rows.withColumn("size", size)
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # two rows per source at most
    return rows.withColumn("base", F.coalesce(F.sum((F.col("stop") - F.col("first")) * F.col("size")).over(before), F.lit(0)))


def _schedule(segments: DataFrame) -> DataFrame:
    """(first, source, turn, slot): earliest deadline first over the unit blocks of one frame.

    Block number j of a source with c of the frame's S slots is released at floor(j S / c) and due at
    ceil((j+1) S / c); each slot takes the released block with the earliest deadline, ties by source.
    Shares add up to one, so every slot is used and every deadline met: at each slot a source has had
    its share to within less than one block. The fold keeps one counter per source and one number per slot.
    """
    slots = F.sequence(F.lit(0).cast("long"), F.col("size") - 1)
    zero = F.struct(F.transform("parts", lambda p: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<i:int,turn:bigint>>").alias("order"))

    def bid(done: Column, t: Column):
        def of(p: Column, i: Column) -> Column:
            had = F.element_at(done, i + 1)
            ready = (had < p["c"]) & (F.floor(had * F.col("size") / p["c"]) <= t)
            return F.when(ready, F.struct(F.ceil((had + 1) * F.col("size") / p["c"]).alias("due"), i.cast("int").alias("i"), had.alias("turn")))

        return F.array_min(F.transform("parts", of))

    def step(state: Column, t: Column) -> Column:
        best = F.array(bid(state["done"], t))
        chosen = F.transform(best, lambda b: F.struct(
            F.transform(state["done"], lambda d, i: F.when(i == b["i"], d + 1).otherwise(d)).alias("done"),
            F.array_append(state["order"], F.struct(b["i"].alias("i"), b["turn"].alias("turn"))).alias("order"),
        ))
        return F.element_at(chosen, 1)

    order = segments.select("first", "parts", F.aggregate(slots, zero, step, lambda s: s["order"]).alias("order"))
    flat = order.select("first", "parts", F.posexplode("order").alias("slot", "o"))
    return flat.select("first", F.element_at("parts", F.col("o.i") + 1)["source"].alias("source"), F.col("o.turn").alias("turn"), F.col("slot").cast("long").alias("slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, frame: int = FRAME) -> DataFrame:
    """(doc_id, source, turn, position) for every row of ``docs``: its place in the mixed order, from 0.

    ``weights`` (source, weight) are the targets; without them they are ``tempered`` counts. A source
    keeps its own order by doc_id; turn is its number there. All rows are placed: a source that runs
    out leaves its slots to the others in proportion. A null source is a source of its own, a null
    doc_id comes first, repeated rows take successive places, sources without a positive finite
    weight get one slot a frame. An empty table gives an empty table; other columns are ignored.

    Numbering a source is dealt by ranges of (source, doc_id) whose counts are added up, so a source
    that holds a third of all rows is numbered by a third of the tasks. Frames and schedules are
    tables whose size depends on the number of sources, not of documents.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    dealt = cut(ids.repartitionByRange("source", "doc_id").withColumn("piece", F.spark_partition_id()))
    quotas = cut(_quotas(dealt, tempered(dealt) if weights is None else weights, frame))
    sizes = dealt.groupBy("source", "piece").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("source").alias("_source"), F.col("piece").alias("_piece"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("piece", "source").orderBy("doc_id")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, (F.col("piece") == F.col("_piece")) & F.col("source").eqNullSafe(F.col("_source")))
    quota = quotas.select(F.col("source").alias("_of"), "q")
    placed = ranked.select("doc_id", "source", (F.col("ahead") + F.col("rank")).alias("turn"))
    placed = placed.join(quota, F.col("source").eqNullSafe(F.col("_of"))).select("doc_id", "source", "turn", F.floor(F.col("turn") / F.col("q")).alias("frame"), (F.col("turn") % F.col("q")).alias("_turn"))
    segments = cut(_segments(quotas))
    frames = segments.select("first", "base", "size", F.explode(F.sequence("first", F.col("stop") - 1)).alias("frame"))
    slots = cut(_schedule(segments)).select(F.col("first").alias("_first"), F.col("source").alias("_source"), F.col("turn").alias("_at"), "slot")
    full = placed.join(frames, "frame")
    full = full.join(slots, (F.col("first") == F.col("_first")) & (F.col("_turn") == F.col("_at")) & F.col("source").eqNullSafe(F.col("_source")))
    position = F.col("base") + (F.col("frame") - F.col("first")) * F.col("size") + F.col("slot")
    return full.select("doc_id", "source", "turn", position.alias("position"))


def arranged(docs: DataFrame, weights: DataFrame | None = None, frame: int = FRAME) -> DataFrame:
    """All rows of ``docs``, columns unchanged, stored in mixed order: partition by partition, sorted inside.

    Rows that repeat a (doc_id, source) stand together at the first of their places.
    """
    own, of, at = free(docs, "mixed_id", "mixed_source", "mixed_position")
    places = mix(docs, weights, frame).groupBy("doc_id", "source").agg(F.min("position").alias(at))
    places = places.select(F.col("doc_id").alias(own), F.col("source").alias(of), at)
    rows = docs.join(places, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & F.col("source").cast("string").eqNullSafe(F.col(of)))
    return rows.repartitionByRange(at).sortWithinPartitions(at).select(*docs.columns)
