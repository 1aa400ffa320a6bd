"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask such as ``11011`` hashes the tokens under its ones and ignores those
under its zeros, so a seed still hits where an ignored token was substituted.
Seeds of all test items and of all documents meet in an equi-join; their rows
hold hashes and places, not words. Each hit fixes an alignment of item and
document. Each alignment is looked at once: the documents that have one are read
again, tokens are compared place by place, and the item counts as found if

- at least ``SHARE`` of all its tokens agree, or
- at least ``SHARE`` of the tokens of some ``RUN`` places in a row agree.

Tokens are runs of letters and digits in lower case. Whole documents are
searched, at every place.

The items' seeds are broadcast if they are at most ``BROADCAST_SEEDS``, as a
count of them shows, and otherwise joined by a shuffle; the plan's results are
the same.

Defined results: null and empty texts contain nothing; items of fewer than
``MIN_TOKENS`` tokens are too short to identify and are not searched for; items
with equal texts are each reported; repeated documents are each searched; rows
of equal doc_id are one document in the report; an empty table gives an empty
report; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Each has four ones; a period of one substitution in five leaves both some place to hit.
MASKS = ("11011", "1011001")
SHARE = 0.8
RUN = 13
MIN_TOKENS = 8
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: Column, mask: str, tag: int) -> Column:
    """Hashes at each place where the mask fits (array, the first at place 0)."""
    ones = [i for i, bit in enumerate(mask) if bit == "1"]
    places = F.size(words) - len(mask)
    return F.when(places >= 0, F.transform(F.sequence(F.lit(0), places), lambda i: F.xxhash64(F.lit(tag), *[F.get(words, i + o) for o in ones]))).otherwise(F.array().cast("array<bigint>"))


def seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row a seed: ``keep``, ``seed`` and ``place``; ``words`` must be among the columns."""
    hashed = rows.select(*keep, F.size("words").alias("_n"), F.concat(*[_seeds(F.col("words"), m, k) for k, m in enumerate(masks)]).alias("_h"))
    # outer: else the optimizer adds a filter that computes the hashes, and the words for each of them, once more
    out = hashed.select(*keep, "_n", F.posexplode_outer("_h").alias("_at", "seed"))
    place, before = F.col("_at"), F.lit(0)
    for m in masks:  # the seeds of one mask follow those of another
        fits = F.greatest(F.col("_n") - len(m) + 1, F.lit(0))
        place = F.when((F.col("_at") >= before) & (F.col("_at") < before + fits), F.col("_at") - before).otherwise(place)
        before = before + fits
    return out.select(*keep, "seed", place.alias("place"))


def alignments(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, doc_hash, item_hash, shift), each once: where some seed of a document meets one of an item.

    Seed rows are of fixed size, without words, so their number bounds the bytes
    of a broadcast (24 each, and the doc_id's on the other side).
    """
    wanted = seeds(items.select("item_hash", "words").dropDuplicates(["item_hash"]), ["item_hash"], masks).where("seed IS NOT NULL")
    wanted = wanted.withColumnRenamed("place", "item_place")
    if wanted.count() <= broadcast_seeds:
        wanted = F.broadcast(wanted)
    hashed = seeds(docs.select("doc_id", "doc_hash", "words"), ["doc_id", "doc_hash"], masks)
    return hashed.join(wanted, "seed").select("doc_id", "doc_hash", "item_hash", (F.col("place") - F.col("item_place")).alias("shift")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_agree, n_item, best_run): every item found in every document."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), tokens(F.col("text")).alias("words")).where(F.size("words") >= MIN_TOKENS)
    cut = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), tokens(F.col("text")).alias("words"))
    # written: its size is known then, and Spark sends it round or shuffles by that
    found = scratch.save(alignments(cut, items, masks, broadcast_seeds), "alignments").withColumnsRenamed({"doc_id": "_id", "doc_hash": "_hash"})
    # only documents with an alignment are cut into words again
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_hash"))
    held = texts.join(found, texts["doc_id"].eqNullSafe(found["_id"]) & (texts["doc_hash"] == found["_hash"])).select("doc_id", "item_hash", "shift", tokens(F.col("text")).alias("words"))
    aligned = held.join(items.select("item_id", "item_hash", F.col("words").alias("item")), "item_hash")
    # the stretch of the document that lies under the item; places outside the document don't agree
    begin = F.greatest(F.col("shift"), F.lit(0))
    aligned = aligned.select("doc_id", "item_id", "item", F.greatest(-F.col("shift"), F.lit(0)).alias("off"), F.slice("words", begin + 1, F.size("item")).alias("under"))
    agree = F.transform("item", lambda w, i: F.when(F.get("under", i - F.col("off")) == w, 1).otherwise(0))
    judged = aligned.select("doc_id", "item_id", F.size("item").alias("n_item"), agree.alias("agree"))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("agree") - RUN + 1, F.lit(1))), lambda i: add(F.slice("agree", i, F.lit(RUN))))
    judged = judged.select("doc_id", "item_id", "n_item", add(F.col("agree")).alias("n_agree"), F.array_max(runs).alias("best_run"))
    best = judged.groupBy("doc_id", "item_id").agg(F.max("n_agree").alias("n_agree"), F.max("n_item").alias("n_item"), F.max("best_run").alias("best_run"))
    return best.where((F.col("n_agree") >= SHARE * F.col("n_item")) | ((F.col("n_item") >= RUN) & (F.col("best_run") >= SHARE * RUN)))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item. The join moves found ids only; documents with a null id stay if clean by themselves."""
    bad = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
