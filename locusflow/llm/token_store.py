"""Token-ID output: one concatenated id array per shard, document boundaries in Elias-Fano code.

A store is a folder of Parquet files whose rows are blocks. A block holds

- ``ids``: the ids of its documents one after another, little-endian, 2 bytes
  each if the vocabulary has at most 65,536 ids, else 4;
- ``doc_ids``: the documents' ids, ascending;
- ``ef``: the end offsets of the documents within the block, in Elias-Fano
  code with a select directory (about 2 + log2(tokens / documents) bits each);
- ``shard``, ``block``, ``shard_start``: where the block's ids begin within
  its shard. Shards are in ascending doc_id order.

Blocks rather than loose files: Spark's commit protocol makes a retried task
leave one copy, and the store can be in any file system that Spark reaches.

Defined results: null text is the empty text and gives only the end id; rows
of equal doc_id all stay, ordered by text; a null doc_id comes first; an empty
table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ByteTable, range_hashes, text_bytes, word_bounds

STORE_SCHEMA = "shard int, block int, shard_start long, n_tokens long, width int, doc_ids array<long>, ids binary, ef binary"

#: Ids of a block, in bytes; a longer document gets a block of its own.
BLOCK_BYTES = 4 << 20
#: A select sample each so many ones of the upper bits.
SELECT_EVERY = 64
#: Slots of a Python worker's memory of pieces; each held piece takes about 40 bytes more.
SLOTS = 1 << 22


# -- Elias-Fano ---------------------------------------------------------------

def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano code of a non-decreasing array of non-negative integers.

    Layout, little-endian: n (u64), low bits l (u64), upper words (u64), then
    ceil(n*l/64) words of low bits, the upper words (bit values[i]>>l + i is
    set) and for each SELECT_EVERY-th one its bit's place (u32).
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = np.zeros((n * low + 63) // 64 * 64, np.uint8)
    for k in range(low):
        bits[k : n * low : low] = (values >> np.uint64(k)) & np.uint64(1)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = ((int(ones[-1]) if n else 0) + 64) // 64
    upper = np.zeros(words * 64, np.uint8)
    upper[ones] = 1
    head = np.array([n, low, words], "<u8").tobytes()
    return b"".join([head, np.packbits(bits, bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes(), ones[::SELECT_EVERY].astype("<u4").tobytes()])


class EliasFano:
    """Reads ``ef_encode``: ``select(i)`` for single values, ``all()`` for every one."""

    def __init__(self, data: bytes):
        self.n, self.low, words = (int(x) for x in np.frombuffer(data, "<u8", 3))
        low_bytes = (self.n * self.low + 63) // 64 * 8
        self._low = np.frombuffer(data, np.uint8, low_bytes, 24)
        self._upper = np.frombuffer(data, "<u8", words, 24 + low_bytes)
        self._samples = np.frombuffer(data, "<u4", offset=24 + low_bytes + 8 * words)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, whole words are skipped by their count of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self._samples[i // SELECT_EVERY]), i % SELECT_EVERY
        word = place // 64
        rest = int(self._upper[word]) >> (place % 64) << (place % 64)
        while (ones := rest.bit_count()) <= left:
            left, word = left - ones, word + 1
            rest = int(self._upper[word])
        for _ in range(left):
            rest &= rest - 1
        high = word * 64 + (rest & -rest).bit_length() - 1 - i
        at = i * self.low
        chunk = int.from_bytes(self._low[at // 8 : (at + self.low + 7) // 8].tobytes(), "little")
        return high << self.low | chunk >> (at % 8) & (1 << self.low) - 1

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._upper.view(np.uint8), bitorder="little")[:])[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        bits = np.unpackbits(self._low, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        for k in range(self.low):
            out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out.astype(np.int64)


# -- encoding -----------------------------------------------------------------

_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
#: Marks that are never part of a pre-token with letters.
_KINDS[list(b".,;:!?")] = 2
_KINDS[[*range(65, 91), *range(97, 123)]] = 3


def unsafe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have white space other than single spaces and line ends between words: there, a cut could split a pre-token."""
    space = _KINDS[data] == 1
    bad = space & (data != 32) & (data != 10)
    bad[: max(0, len(data) - 1)] |= space[1:] & space[:-1]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    bad[ends] = space[ends]  # the first byte of the next text is no neighbour; white space at the end is unsafe
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        x, y, z = wide[lead], wide[lead + 1], wide[lead + 2]
        bad[lead] |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) | (x == 0xE2) & ((y == 0x81) | (y == 0x80) & ((z <= 0x8A) | (z >= 0xA8))) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    count = np.concatenate([[0], np.cumsum(bad)])
    return count[offsets[1:]] > count[offsets[:-1]]


class PieceEncoder:
    """Ids of whole texts from the tokenizers library, remembering those of pieces.

    A byte-level BPE encodes each pre-token by itself. A single space between
    other characters begins a pre-token, a single line end between them is one,
    and marks after a letter begin one. So a text's ids are those of its pieces
    ``word``, `` word``, ``,``, ... one after another. Texts with other white
    space go to the library whole.

    Pieces are found, looked up and put together for many texts at once. The
    memory maps the pieces' bytes, compared in full, to places in a pool of
    ids; it starts afresh when it is three fifths full.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.line_id = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self._clear(slots)

    def _clear(self, slots: int) -> None:
        self.table, self.places = ByteTable(slots), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(slots, self.dtype), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece) of pieces without line ends: all in one text, a line each."""
        ids = self.whole(["\n".join(pieces)])[0]
        cuts = ids == self.line_id
        if cuts.sum() != len(pieces) - 1:
            each = self.whole(pieces)
            return np.concatenate(each), np.array([len(x) for x in each])
        return ids[~cuts], np.diff(np.concatenate([[-1], np.flatnonzero(cuts), [len(ids)]])) - 1

    def _learn(self, data, a, z, hashes, spaced, raw: bytes) -> None:
        ids, sizes = self._encode([(" " if s else "") + raw[p:q].decode() for s, p, q in zip(spaced.tolist(), a.tolist(), z.tolist(), strict=True)])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        n, more = self.table.count, len(a)
        if n + more > len(self.places):
            self.places = np.concatenate([self.places, np.zeros(max(len(self.places), more), np.int64)])
        self.places[n : n + more] = self.used + np.cumsum(sizes) - sizes << 24 | sizes
        self.used += len(ids)
        self.table.add(data, a, z, hashes, spaced)

    def __call__(self, column) -> list[bytes]:
        """The ids' bytes of each text of an Arrow column."""
        data, offsets = text_bytes(column)
        risky = unsafe(data, offsets)
        starts, ends, first = word_bounds(data, offsets)
        doc = np.repeat(np.arange(len(risky)), np.diff(first))
        keep = ~risky[doc]
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
        before = np.where(starts > offsets[doc], data[np.maximum(starts - 1, 0)], 0)
        # marks at the end of a word, after an ASCII or Latin-1 letter, are a piece of their own
        kind = _KINDS[data]
        cut = ends.copy()
        for _ in range(3):
            more = (cut > starts + 1) & (kind[np.maximum(cut - 1, 0)] == 2)
            cut -= more
        last, lead = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
        letter = (kind[np.maximum(cut - 1, 0)] == 3) | (lead == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7) & (cut - 2 >= starts)
        cut = np.where(letter, cut, ends)
        marked = cut < ends
        # pieces: each word, then its marks if any
        at = np.arange(len(starts)) + np.cumsum(marked) - marked
        n = len(starts) + int(marked.sum())
        a, z, spaced, line, of = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool), np.zeros(n, bool), np.empty(n, np.int64)
        a[at], z[at], spaced[at], line[at], of[at] = starts, cut, before == 32, before == 10, doc
        tail = at[marked] + 1
        a[tail], z[tail], of[tail] = cut[marked], ends[marked], doc[marked]
        hashes = range_hashes(data, a, z)
        entry = self.table.find(data, a, z, hashes, spaced)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            first_of = lambda at: list({(s, raw[p:q]): i for i, s, p, q in zip(at.tolist(), spaced[at].tolist(), a[at].tolist(), z[at].tolist(), strict=True)}.values())
            fresh = np.array(first_of(new))
            slots = len(self.table.index)
            if 5 * (self.table.count + len(fresh)) > 3 * slots:
                fresh = np.array(first_of(np.arange(n)))
                while 5 * len(fresh) > 3 * slots:
                    slots *= 2
                self._clear(slots)
            self._learn(data, a[fresh], z[fresh], hashes[fresh], spaced[fresh], raw)
            entry = self.table.find(data, a, z, hashes, spaced)
        place = self.places[entry]
        sizes, begin = place & 0xFFFFFF, place >> 24
        total = sizes + line
        ends_at = np.cumsum(total)
        run = np.arange(int(sizes.sum()))
        held = np.cumsum(sizes) - sizes
        flat = np.empty(int(total.sum()), self.dtype)
        flat[run + np.repeat(ends_at - sizes - held, sizes)] = self.pool[run + np.repeat(begin - held, sizes)]
        flat[(ends_at - total)[line]] = self.line_id
        bounds = np.concatenate([[0], ends_at])[np.searchsorted(of, np.arange(len(risky) + 1))].tolist()
        out = [flat[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
        odd = np.flatnonzero(risky).tolist()
        for i, ids in zip(odd, self.whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in odd]), strict=True):
            out[i] = ids.tobytes()
        return out


#: A Python worker serves many tasks; what it remembers stays.
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _batches(column, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes of a column of texts."""
    import pyarrow.compute as pc

    n = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(n, (n[first - 1] if first else 0) + size)))
        yield first, last
        first = last


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, order: list | None = None) -> None:
    """Write ``docs`` (doc_id, text) to a store in ascending doc_id order, or in that of the columns ``order``.

    One shuffle: the rows are dealt by range and sorted, then encoded where they lie.
    """
    key = [F.col("doc_id")] if order is None else order
    frame = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[c.alias(f"_k{i}") for i, c in enumerate(key)])
    keys = [f"_k{i}" for i in range(len(key))]
    ranged = frame.repartitionByRange(*keys).sortWithinPartitions(*keys, "doc_id", "text").select("doc_id", "text")

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        dtype, shard = encode.dtype, TaskContext.get().partitionId()
        end = np.array([end_id], dtype).tobytes()
        ids, buffers, held, block, start = [], [], 0, 0, 0

        def flush():
            nonlocal ids, buffers, held, block, start
            ends = np.cumsum([len(b) // dtype.itemsize for b in buffers])
            row = {"shard": [shard], "block": [block], "shard_start": [start], "n_tokens": [int(ends[-1])], "width": [dtype.itemsize], "doc_ids": [ids], "ids": [b"".join(buffers)], "ef": [ef_encode(ends)]}
            block, start = block + 1, start + int(ends[-1])
            ids, buffers, held = [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=_arrow_schema())

        for batch in batches:
            doc_ids, column = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in _batches(column):
                for doc_id, b in zip(doc_ids[lo:hi], encode(column.slice(lo, hi - lo)), strict=True):
                    if held and held + len(b) > BLOCK_BYTES:
                        yield flush()
                    ids.append(doc_id)
                    buffers.append(b + end)
                    held += len(b) + dtype.itemsize
        if buffers:
            yield flush()

    ranged.mapInArrow(blocks, STORE_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _arrow_schema():
    import pyarrow as pa

    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary()), ("ef", pa.binary())])


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks with ``start``: ids before the block in the whole store.

    Only one number for each shard goes through the ordered sum.
    """
    blocks = spark.read.schema(STORE_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    return blocks.join(base, "shard").withColumn("start", F.col("shard_base") + F.col("shard_start"))


def digests(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of an opened store."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for start, width, doc_ids, ids, ef in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                ends = EliasFano(ef).all()
                begins = np.concatenate([[0], ends[:-1]])
                data = np.frombuffer(ids, f"<u{width}").astype("<u4")
                crc = [zlib.crc32(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(begins + start, pa.int64()), "n_tokens": pa.array(ends - begins, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return store.select("start", "width", "doc_ids", "ids", "ef").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_of(store: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<int>) of each document, for readers that want the ids themselves."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for start, width, doc_ids, ids, ef in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                ends = EliasFano(ef).all()
                begins = np.concatenate([[0], ends[:-1]])
                data = np.frombuffer(ids, f"<u{width}").astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(data))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(begins + start, pa.int64()), "ids": values})

    return store.select("start", "width", "doc_ids", "ids", "ef").mapInArrow(read, "doc_id long, start long, ids array<int>")
