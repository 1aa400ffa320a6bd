"""N-gram Jaccard join by chosen paths.

A document's set holds its shingles of five words, each as a hash of 128 bits in
two lanes of 64. Documents with equal sets (by 128 bits) are one class, joined
once and expanded at the end. The sets are embedded as ``COORDINATES`` min-hashes, so that two sets of similarity s share
each coordinate with probability s: a coordinate is a token both may have
chosen.

Each of ``runs`` runs begins with one coordinate and puts the sets that share
its token into one bucket. A bucket above ``LIMIT`` is split again, on two more
sampled coordinates (their tokens are the next step of two paths), until it is
small, or hardly shrinks because its sets are all alike, or the path has
``DEPTH`` steps. Buckets so reached are compared by brute force. The number of
runs follows from the target recall. Buckets that stay large are compared in
full too, in blocks of ``BLOCK`` against blocks, each pair of blocks a group of
its own; no partner or candidate is dropped.

A pair in several buckets counts in the first of those that both sets are in.
It is a link if the Jaccard similarity of the whole sets is at least 0.8, which
is computed from the sets themselves, both lanes of every shingle; min-hashes
only rule out pairs of an estimate under ``ESTIMATE``. A comparison gives counts of links and a spanning
forest, never the pairs, so what it writes grows with the sets.

Defined results: words are runs without ASCII white space, case kept; a text of
one to four words has one shingle of all of them; a null or empty text has no
shingle, no link and a class of its own; equal texts link to each other; rows
of equal doc_id are joined by their texts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, range_hashes, text_bytes, word_bounds

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 32
RECALL = 0.9995
LIMIT = 256
DEPTH = 6
#: A part of a bucket of over this share is as alike as the bucket.
ALIKE = 0.6
BLOCK = 512
#: Of COORDINATES: a pair at 0.8 falls below with probability 6e-5.
ESTIMATE = 16
#: Words of 64 bits in the filter that tells which documents' sets are fetched: a quarter of one for each wanted
#: document, within these bounds (8 KiB and 32 MiB are sent round). A fuller filter passes more, never less.
FILTER_WORDS = (1 << 10, 1 << 22)

_SALTS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def runs_for(recall: float) -> int:
    """Runs until a pair at the threshold is found with probability ``recall``.

    One run keeps such a pair with 0.8 in the first step and, where a bucket is
    split, 1 - 0.2**2 in each further one; three are allowed for.
    """
    one = SIMILARITY * (1 - (1 - SIMILARITY) ** 2) ** 3
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def shingle_sets(column):
    """Yield the distinct shingles of each text of an Arrow column: (2, n) uint64, the lanes of each, by the first lane."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    words = np.stack([range_hashes(data, starts, ends, lane) for lane in (0, 1)])
    n = max(0, len(starts) - WORDS + 1)
    five = np.zeros((2, n), np.uint64)
    for k in range(WORDS):
        five = _step(five, words[:, k : n + k])
    five = mix(five)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= WORDS:
            here = five[:, a : z - WORDS + 1]
            yield here[:, np.unique(here[0], return_index=True)[1]]
        elif z > a:
            h = np.full((2, 1), z - a, np.uint64)
            for k in range(a, z):
                h = _step(h, words[:, k : k + 1])
            yield mix(h)
        else:
            yield np.zeros((2, 0), np.uint64)


def _step(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h * np.uint64(0x2545F4914F6CDD1D) + word


def _set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, one a lane: sums of mixed elements."""
    out = np.zeros((2, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            if s.shape[1]:
                out[:, i] = np.add.reduce(mix(s ^ np.uint64(0xA5A5)), axis=1) + np.uint64(s.shape[1])
    return mix(out[0]).view(np.int64), mix(out[1]).view(np.int64)


def _min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) uint32; the sets aren't empty."""
    flat, starts = np.concatenate([s[0] for s in sets]), np.cumsum([0] + [s.shape[1] for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            out[:, i] = np.minimum.reduceat(((flat * _SALTS[2 * i] + _SALTS[2 * i + 1]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, check, n, sig): the set's digests, size and min-hashes; one pass over whole texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = list(shingle_sets(part.column(1)))
                rid, check = _set_ids(sets)
                full = [i for i, s in enumerate(sets) if s.shape[1]]
                sig: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, _min_hashes([sets[i] for i in full]), strict=True):
                        sig[i] = row.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rid), pa.array(check), pa.array([s.shape[1] for s in sets], pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "rid", "check", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, rid long, check long, n long, sig binary")


def _token(coordinate) -> F.Column:
    """The min-hash at a coordinate (from 0), as the bytes of the signature."""
    return F.substring(F.col("sig"), coordinate * 4 + 1, F.lit(4))


def buckets(reps: DataFrame, scratch: Scratch, runs: int, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(rid, path, n): the buckets to compare, each of two sets or more."""
    first = reps.select("rid", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "sig")
    paths = first.select("rid", F.xxhash64("run", _token(F.col("run"))).alias("path"), F.lit(None).cast("long").alias("parent"))
    leaves = []
    for level in range(1, depth + 1):
        # written first: the join then deals out both sides itself and can split a path that many sets are on
        counts = scratch.save(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"counts{level}")
        live = scratch.save(paths.join(counts, "path"), f"level{level}")
        large = (F.col("n") > limit) & (F.col("parent").isNull() | (F.col("n") < ALIKE * F.col("parent")))
        if level == depth:
            leaves.append(live.select("rid", "path", "n"))
            break
        leaves.append(live.where(~large).select("rid", "path", "n"))
        split = live.where(large)
        if split.isEmpty():
            break
        step = split.join(reps.select("rid", "sig"), "rid").select("rid", "path", "n", "sig", F.explode(F.array(F.lit(1), F.lit(2))).alias("child"))
        coordinate = F.pmod(F.xxhash64("path", "child"), F.lit(COORDINATES)).cast("int")
        paths = step.select("rid", F.xxhash64("path", "child", _token(coordinate)).alias("path"), F.col("n").alias("parent"))
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    # two paths may end at the same sets; a set is in a bucket once
    return out.dropDuplicates(["rid", "path"])


def _groups(leaves: DataFrame, block: int) -> DataFrame:
    """(path, i, j, side, rid): block i of a bucket against block j; a small bucket is one block."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = leaves.select("rid", "path", blocks.alias("nb"), F.pmod(F.xxhash64("rid", "path"), blocks).cast("int").alias("b"))
    other = own.select("rid", "path", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x"))
    return other.select("rid", "path", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), (F.col("b") > F.col("x")).alias("side"))


def _grouped(batches):
    """Tables of whole groups (path, i, j) from batches sorted by them; the last group waits for its end."""
    import pyarrow as pa

    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows < 20_000:
            continue
        key = np.stack([held.column(c).to_numpy() for c in ("path", "i", "j")])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
        if len(change):
            cut = int(change[-1]) + 1
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _candidates(t):
    """Pairs of row places of a table of whole groups that its bucket is to compare.

    Left out: pairs within one side of two different blocks (another group has
    them), of too low an estimate, and of which an earlier bucket has both.
    """
    path, i, j = (t.column(c).to_numpy() for c in ("path", "i", "j"))
    side = t.column("side").to_numpy(zero_copy_only=False)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
    leaves = [frozenset(x) for x in t.column("leaves").to_pylist()]
    key = np.stack([path, i, j])
    starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(path)]])
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if z - a < 2:
            continue
        two_blocks, p = i[a] != j[a], path[a]
        for x in range(a, z - 1):
            same = (sig[x + 1 : z] == sig[x]).sum(1)
            near = same >= ESTIMATE
            if two_blocks:
                near &= side[x + 1 : z] != side[x]
            for y in (np.flatnonzero(near) + x + 1).tolist():
                if min(leaves[x] & leaves[y]) == p:
                    yield x, y


def _needed(groups: DataFrame) -> DataFrame:
    """The rows of groups that have a candidate pair there."""

    def run(batches):
        for t in _grouped(batches):
            keep = np.zeros(t.num_rows, bool)
            for x, y in _candidates(t):
                keep[x] = keep[y] = True
            yield from t.filter(keep).to_batches()

    return groups.mapInArrow(run, groups.schema)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(a.shape[1], b.shape[1]) < SIMILARITY * max(a.shape[1], b.shape[1]):
        return False
    at = np.searchsorted(a[0], b[0])
    at[at == a.shape[1]] = 0
    both = int((a[:, at] == b).all(0).sum())
    return both >= SIMILARITY * (a.shape[1] + b.shape[1] - both)


def _linked(groups: DataFrame) -> DataFrame:
    """(a, b, links): for each set its links to others, copies counted (b null), and forest edges (links 0)."""

    def run(batches):
        import pyarrow as pa

        for t in _grouped(batches):
            sets = [np.frombuffer(x, "<u8").reshape(2, -1) for x in t.column("shingles").to_pylist()]
            rid, copies = t.column("rid").to_numpy(), t.column("copies").to_numpy()
            path = t.column("path").to_numpy()
            links, parent = np.zeros(len(rid), np.int64), list(range(len(rid)))

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in _candidates(t):
                if _similar(sets[x], sets[y]):
                    links[x] += copies[y]
                    links[y] += copies[x]
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        low, high = (rx, ry) if rid[rx] < rid[ry] else (ry, rx)
                        parent[high] = low
            roots = np.array([root(x) for x in range(len(rid))])
            assert (path[roots] == path).all()
            n = np.flatnonzero(links)
            e = np.flatnonzero(roots != np.arange(len(rid)))
            a = np.concatenate([rid[n], rid[e]])
            b = pa.array(np.concatenate([rid[n], rid[roots[e]]]), mask=np.arange(len(a)) < len(n))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[n], np.zeros(len(e), np.int64)]))], names=["a", "b", "links"])

    return groups.mapInArrow(run, "a long, b long, links long")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit filter over ``doc_id`` that never misses one: made on executors, its words (bounded) come to the driver."""
    n = ids.count()
    words = min(max(FILTER_WORDS[0], 1 << (n // 4).bit_length()), FILTER_WORDS[1])
    both = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(words * 64)) for k in (1, 2)])
    bits = ids.select(F.explode(both).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    got = bits.toArrow()
    out = np.zeros(words, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def filter_places(words: int) -> list:
    """The columns of a document's two places in a filter of so many words."""
    return [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(words * 64)).alias(f"_b{k}") for k in (1, 2)]


def passing(batch, words: np.ndarray) -> np.ndarray:
    """Which rows of (doc_id, text, places) may be wanted."""
    hit = np.ones(batch.num_rows, bool)
    for k in (2, 3):
        b = batch.column(k).to_numpy()
        hit &= (words[b >> 6] >> (b & 63)) & 1 == 1
    return hit


def fetch_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, shingles) of the wanted sets (rid, doc_id).

    Texts aren't shuffled: a filter of the wanted ids goes to the scan, which
    makes sets only of documents that pass.
    """
    bits = id_filter(wanted.where(F.col("doc_id").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            unknown = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(passing(batch, shared.value) | unknown))
            for lo in range(0, some.num_rows, 512):
                part = some.slice(lo, 512)
                sets = list(shingle_sets(part.column(1)))
                rid, _ = _set_ids(sets)
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["rid", "shingles"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", *filter_places(len(bits))).mapInArrow(run, "rid long, shingles binary")
    return made.join(wanted.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.first("shingles").alias("shingles"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating stars.

    Each round links every node's larger neighbours (then: all its neighbours
    not larger) to its least one; rounds grow with the logarithm of the number
    of nodes. Every round is written, so lost executors cost one round at most.
    Nodes may be of any type that has an order.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    last, k = None, 0
    while True:
        k += 1
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.save(small, f"edges{k}")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(f"edges{k - 1}")
        if state == last:
            break
        last = state
    own = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return own.union(own.select(F.col("component").alias("node"), "component").distinct())


def join(docs: DataFrame, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links): the least doc_id of each document's connected group, and its links."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    every = scratch.save(sketches(docs), "sketches")
    classes = every.where("n > 0").groupBy("rid", "check").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("sig").alias("sig"))
    reps = scratch.save(classes, "reps")
    leaves = scratch.save(buckets(reps, scratch, runs_for(recall), limit), "leaves")
    lists = leaves.groupBy("rid").agg(F.collect_list("path").alias("leaves")).join(reps, "rid")
    order = ["path", "i", "j"]
    groups = _groups(leaves, block).join(lists.select("rid", "sig", "leaves", "copies", "doc_id"), "rid").repartition(*order).sortWithinPartitions(*order)
    needed = scratch.save(_needed(groups), "needed")
    sets = fetch_sets(docs, needed.select("rid", "doc_id").distinct())
    linked = scratch.save(_linked(needed.join(sets, "rid").repartition(*order).sortWithinPartitions(*order)), "linked")
    counted = linked.where("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    member = components(linked.where("b IS NOT NULL").select("a", "b"), scratch).withColumnRenamed("node", "rid")
    named = member.join(reps.select("rid", "doc_id"), "rid")
    class_ids = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    grouped = named.join(class_ids, "component").select("rid", "class_id")
    info = reps.select("rid", "check", "doc_id", "copies").join(counted, "rid", "left").join(grouped, "rid", "left")
    info = scratch.save(info.select("rid", "check", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "info")
    full = every.where("n > 0").select("doc_id", "rid", "check").join(info, ["rid", "check"]).select("doc_id", "class_id", "n_links")
    return full.unionByName(every.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, one of each connected group: the one of least doc_id.

    Rows that repeat a kept one in doc_id and text go; documents without words
    stay. A null doc_id's group, where all its ids are null, keeps its rows.
    """
    found = join(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct().withColumnRenamed("doc_id", "_kept")
    kept = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
