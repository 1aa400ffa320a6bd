"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents are cut into blocks of ``block`` documents. With
integer weights w that sum to W over the sources that still have blocks, the
j-th block of a source is released at slot floor((j-1) W / w) and due at slot
ceil(j W / w); of the released blocks, the one with the earliest deadline goes
first. So after every slot t each source has had its fluid share t w / W to
within less than one block.

The schedule of one phase repeats every W slots, W at most ``PERIOD``, so its
first W slots are all there is to compute. A phase ends when a source has no
block left; the next one has the weights of the rest. That plan is made on the
driver from one count a source, at most ``MAX_SOURCES`` of them (more is an
error), and holds at most MAX_SOURCES * PERIOD slots; every document then finds
its place by arithmetic.

A source's documents are numbered in the order of a hash of doc_id (and text,
where there is one). Numbering sorts cells of about ``CELL`` documents, whatever
a source's size, and adds up the cells' sizes in two steps, each of the square
root of their number.

Defined results: a null source is a source of its own; null texts and repeated
rows are documents like others (ties of equal doc_id: by text); a source
without a weight gets the weight 1; an empty table gives an empty plan; columns
of the same names as those added are replaced.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32
PERIOD = 1000
MAX_SOURCES = 1000
CELL = 64


def period(weights: list[int]) -> list[list[int]]:
    """The slots of each source in one period of sum(weights) slots."""
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    released: list[tuple[int, int]] = []
    waiting = [(0, i) for i, w in enumerate(weights) if w]
    heapq.heapify(waiting)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            j = len(slots[i]) + 1
            heapq.heappush(released, (-(-j * total // weights[i]), i))
        _, i = heapq.heappop(released)
        slots[i].append(t)
        if len(slots[i]) < weights[i]:
            heapq.heappush(waiting, (len(slots[i]) * total // weights[i], i))
    return slots


def plan(counts: list[int], weights: list[int], block: int) -> list[list[dict]]:
    """For each source its phases: first block, first slot, W, w, slots of a period, documents missing from earlier last blocks."""
    left = [-(-n // block) for n in counts]
    out: list[list[dict]] = [[] for _ in counts]
    used, start, missing = [0] * len(counts), 0, 0
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        slots = period([weights[i] for i in active])
        total = sum(weights[i] for i in active)
        ends = [(left[i] - 1) // weights[i] * total + s[(left[i] - 1) % weights[i]] + 1 for i, s in zip(active, slots, strict=True)]
        length = min(ends)
        for i, s, end in zip(active, slots, ends, strict=True):
            out[i].append({"first": used[i], "start": start, "total": total, "weight": weights[i], "slots": s, "missing": missing})
            took = length // total * weights[i] + sum(x < length % total for x in s)
            used[i] += took
            left[i] -= took
        done = active[ends.index(length)]
        missing += -counts[done] % block
        start += length
    return out


def root_weights(counts: list[int], total: int = PERIOD) -> list[int]:
    """Weights in proportion to the square roots of the counts, at least 1, about ``total`` in sum."""
    roots = [n**0.5 for n in counts]
    return [max(1, round(total * r / sum(roots))) for r in roots]


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """``docs`` with ``position`` (dense, from 0), ``slot``, ``block`` and ``phase``.

    Without ``weights``, each source's target is in proportion to the square
    root of its documents.
    """
    spark = docs.sparkSession
    docs = docs.drop("position", "slot", "block", "phase")
    counted = docs.groupBy("source").count().limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counted = sorted(((r["source"], r["count"]) for r in counted), key=lambda x: (x[0] is None, x[0] or ""))
    counts = [n for _, n in counted]
    target = root_weights(counts) if weights is None else [int(weights.get(s, 1)) for s, _ in counted]
    if any(w < 1 for w in target) or sum(target) > max(2 * PERIOD, 2 * len(target)):
        raise ValueError("weights must be positive integers that sum to at most twice the period")
    rows = [{"source": s, "cells": -(-n // cell), "phases": p} for (s, n), p in zip(counted, plan(counts, target, block), strict=True)]
    schema = "array<struct<source string, cells bigint, phases array<struct<first bigint, start bigint, total bigint, weight bigint, slots array<int>, missing bigint>>>>"
    planned = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema))).withColumnRenamed("source", "_source")
    # every source has cells of the same size, and rows of equal doc_id but different text spread
    cells = planned.select(F.col("_source").alias("_of"), F.col("cells").alias("_cells"))
    keyed = docs.withColumn("_hash", F.xxhash64("doc_id", *(["text"] if "text" in docs.columns else []), F.lit(23)))
    keyed = keyed.join(F.broadcast(cells), F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("_cell", F.pmod("_hash", "_cells")).drop("_of", "_cells")
    sizes = keyed.groupBy("source", "_cell").agg(F.count("*").alias("_n"))
    # running sums within rows of cells, and over the rows: no task orders all cells of a source
    row = F.expr(f"_cell div {max(1, math.isqrt(max(counts, default=0) // cell))}")
    within_row = sizes.withColumn("_row", row)
    sums = within_row.groupBy("source", "_row").agg(F.sum("_n").alias("_sum"))
    ahead = sums.select(F.col("source").alias("_s2"), F.col("_row").alias("_r2"), (F.sum("_sum").over(Window.partitionBy("source").orderBy("_row")) - F.col("_sum")).alias("_ahead"))
    of_row = F.sum("_n").over(Window.partitionBy("source", "_row").orderBy("_cell")) - F.col("_n")
    starts = within_row.select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), "_row", of_row.alias("_here"))
    starts = starts.join(ahead, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_row") == F.col("_r2"))).select("_s", "_c", (F.col("_here") + F.col("_ahead")).alias("_before"))
    within = Window.partitionBy("source", "_cell").orderBy("_hash", "doc_id", *(["text"] if "text" in docs.columns else []))
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    joined = joined.withColumn("block", F.expr(f"_rank div {block}"))
    joined = joined.join(F.broadcast(planned.drop("cells")), F.col("source").eqNullSafe(F.col("_source")))
    joined = joined.withColumn("phase", F.size(F.filter("phases", lambda p: p["first"] <= F.col("block"))) - 1)
    at = F.get("phases", F.col("phase"))
    joined = joined.withColumn("_at", at).withColumn("_j", F.col("block") - F.col("_at.first"))
    slot = F.col("_at.start") + F.expr("(_j div _at.weight) * _at.total") + F.get("_at.slots", F.expr("cast(_j % _at.weight as int)"))
    joined = joined.withColumn("slot", slot)
    position = F.col("slot") * block - F.col("_at.missing") + F.expr(f"_rank % {block}")
    return joined.withColumn("position", position).select(*docs.columns, "position", "slot", "block", "phase")
