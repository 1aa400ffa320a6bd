"""Shared folders, tables that cut lineage, and byte-level text features."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then uses a
    folder of this machine, as tests do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


class Scratch:
    """Tables written once to the shared folder, which cut lineage.

    A lost executor costs only the tasks it ran: later stages read the files
    again. The folder goes when the driver's JVM ends, or earlier by ``drop``.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/locusflow-{what}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled training rows.

    The rows are those with the smallest hashes of doc_id, so a rerun takes the
    same ones. At most ``rows`` pairs are broadcast: that is the bound.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy; null reads as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What is left of eight bytes of which k count.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: By lane: a multiplier and a start.
_LANES = ((np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)), (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)))
#: Longer ranges are hashed by xxh3.
_LONG = 256


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a byte array on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def chunk(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of ranges of which all are longer than 8 k (k = 0: of any length)."""
    return view[starts + 8 * k] & _MASKS[np.minimum(sizes - 8 * k, 8)]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of ranges of a byte array, eight bytes at a time; ranges of one length up to eight never collide.

    Longer ones may, so what must be exact compares bytes as well (``ByteTable``) or takes both lanes.
    """
    odd, seed = _LANES[lane]
    view, sizes = eights(data), ends - starts
    with np.errstate(over="ignore"):
        h = mix(sizes.astype(np.uint64) * odd + seed)
        todo, k = np.arange(len(starts)), 0
        while len(todo):
            here = chunk(view, starts[todo], sizes[todo], k)
            h[todo] = mix((h[todo] ^ here) * odd)
            k += 1
            left = sizes[todo]
            todo = todo[(left > 8 * k) & (left <= _LONG)]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        import xxhash

        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=lane)
    return h


class ByteTable:
    """An exact map from byte strings (with a small tag) to numbers from 0 on, for many strings at once.

    A hash finds a place, open addressing the next one; the strings themselves,
    kept eight bytes at a time, decide.
    """

    def __init__(self, slots: int):
        self.index, self.count, self.used = np.full(slots, -1, np.int32), 0, 0
        self.sizes, self.first = np.zeros(1024, np.int64), np.zeros(1024, np.uint64)
        self.rest, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.uint64)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])

    def _same(self, entry, view, starts, sizes, tagged) -> np.ndarray:
        same = self.sizes[entry] == tagged
        same &= self.first[entry] == chunk(view, starts, sizes, 0)
        todo, k = np.flatnonzero(same & (sizes > 8)), 1
        while len(todo):
            fine = self.pool[self.rest[entry[todo]] + k - 1] == chunk(view, starts[todo], sizes[todo], k)
            same[todo[~fine]] = False
            k += 1
            todo = todo[fine]
            todo = todo[sizes[todo] > 8 * k]
        return same

    def _keys(self, hashes, tags):
        with np.errstate(over="ignore"):
            return hashes if tags is None else mix(hashes + tags.astype(np.uint64))

    def find(self, data, starts, ends, hashes, tags=None) -> np.ndarray:
        """The number of each string, -1 for those not held."""
        mask = len(self.index) - 1
        view, sizes = eights(data), ends - starts
        tagged = sizes * 2 + (0 if tags is None else tags)
        at = (self._keys(hashes, tags) & np.uint64(mask)).astype(np.int64)
        out = self.index[at]
        todo = np.flatnonzero(out >= 0)
        while len(todo):
            todo = todo[~self._same(out[todo], view, starts[todo], sizes[todo], tagged[todo])]
            at[todo] = at[todo] + 1 & mask
            out[todo] = self.index[at[todo]]
            todo = todo[out[todo] >= 0]
        return out

    def add(self, data, starts, ends, hashes, tags=None) -> None:
        """Hold strings, different from each other and from those held; they get the next numbers in order."""
        n, sizes = len(starts), ends - starts
        own = np.arange(self.count, self.count + n)
        words = np.maximum(0, (sizes + 7) // 8 - 1)
        self.sizes, self.first, self.rest = (self._room(a, self.count + n) for a in (self.sizes, self.first, self.rest))
        self.pool = self._room(self.pool, self.used + int(words.sum()) + 1)
        view = eights(data)
        self.sizes[own] = sizes * 2 + (0 if tags is None else tags)
        self.first[own] = chunk(view, starts, sizes, 0)
        self.rest[own] = self.used + np.cumsum(words) - words
        todo, k = np.flatnonzero(sizes > 8), 1
        while len(todo):
            self.pool[self.rest[own[todo]] + k - 1] = chunk(view, starts[todo], sizes[todo], k)
            k += 1
            todo = todo[sizes[todo] > 8 * k]
        self.used, self.count = self.used + int(words.sum()), self.count + n
        mask = len(self.index) - 1
        at = (self._keys(hashes, tags) & np.uint64(mask)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):  # two may want one place: one gets it, the others seek on
            free = todo[self.index[at[todo]] < 0]
            self.index[at[free]] = own[free]
            todo = todo[self.index[at[todo]] != own[todo]]
            at[todo] = at[todo] + 1 & mask


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of all texts, in order; no loop runs over words.

    Words are runs without bytes 0x20 and 0x09 to 0x0D. ``first[i]`` is the
    index of text i's first word, with one entry more for the end.
    """
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = solid[1:] != solid[:-1]
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets] = True
    # a text's first byte starts a word of its own even if the one before is solid
    joint = np.flatnonzero(starts_text[:n] & solid[1:-1] & solid[:-2]) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    starts = np.sort(np.concatenate([at[0::2], joint]))
    ends = np.sort(np.concatenate([at[1::2], joint]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first) of the words of all texts."""
    starts, ends, first = word_bounds(data, offsets)
    return range_hashes(data, starts, ends), starts, ends, first


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), by Newton's steps on smoothed targets."""
    up, down = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)])
    theta = np.array([1.0, np.log((up + 1) / (down + 1))])
    loss = lambda t: float(np.sum(np.logaddexp(0, t @ x) - target * (t @ x)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-9 * np.eye(2), x @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])
