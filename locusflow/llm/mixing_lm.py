"""LM scoring by online logistic context mixing.

A text is its words (runs without ASCII white space, A-Z in lower case) and an
end. Each token is a path of bits through a Huffman tree of the ``HEAD`` most
frequent training words, the end and an escape; an escaped word is drawn by its
count if it is one of the rarer training words, and spelt if it is new, each
byte a path through a Huffman tree of bytes. The speller learns from the words
seen once, which new words are most like. Each word of the tree is foretold to
its last bit; no branch is drawn by its count alone.

Every bit is predicted from several contexts: none (the node's prior), the last
two of the ``COMMON`` commonest words (which tell the language), and the last
word, or the last two where the last is one of the ``FREQUENT`` most frequent;
in spelling the last two, three and four bytes. A context and the node hash to
a slot of a table that counts how often 0 and 1 came there. The
predictions, as logits, are mixed by weights of which a gate (the evidence of
the contexts, the depth of the node) selects the set, and a last table refines
the result by what came true at it.

Learning is online and leaves no training row out. Each task reads its training
texts in order: it predicts them from what it has counted so far, moves the
weights by the errors (Adagrad steps of small batches), notes the last table's
outcomes, and only then counts them. Counts and outcomes of all tasks are added
up, the weights averaged by the evidence behind them, both in a tree of sums in
which no task reads more than ``FAN`` parts. The tasks are Spark's partitions of
the input, so scores may differ in the last places between clusters that cut
files differently, and not otherwise.

Scoring adapts to each text as it goes: three models (the mixture, the prior
alone, the longest context sharpened) are weighted by how well they foretold
the ``WINDOW`` tokens before. A training text is scored leave-one-out: each bit
is taken out of the tables when it is predicted, a rare word's occurrences in
the text out of its count, so a training score is about that of a text seen for
the first time, and a text that occurs twice stands out. (Left in: the tree's
shape and the weights.) The base score is that of the contract, with the text's
own counts.

``score`` is over the same events as the base score, in which all unseen words
are one; ``spelt_score`` and ``bits_per_byte`` pay for their letters as well.

Tables have a slot for each token up to 2**22, so what is broadcast is bounded
whatever the corpus; the words' counts are of all words and grow with it. Rare
words and their spelling go through a join on words instead.

Defined results: null and empty texts are an end alone; rows of equal doc_id
are scored each; without training documents every count is 0 and the untrained
predictors give even odds; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ByteTable, Scratch, mix, range_hashes, text_bytes, word_bounds

HEAD = 1 << 18
#: Bounds of the tables' slots, as powers of two; between them they follow the number of tokens or letters.
WORD_BITS, SPELL_BITS = (16, 22), (16, 21)
#: Slots of a piece of a table in the shuffle, and parts that one task adds up.
PIECE, FAN = 1 << 16, 32
#: Words whose order of appearance makes the first context; words that the second context looks behind.
COMMON, FREQUENT = 64, 1024
RATE, BATCH = 0.05, 8192
#: Weight of the node's prior within a context's counts.
TRUST = 0.5
WINDOW, SHARPEN = 24, 2.5

_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


# -- codes --------------------------------------------------------------------

def _merged(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mass, kids): Huffman's merges of leaves of these masses, each a node behind the leaves and those before it."""
    n = len(mass)
    order = np.argsort(mass, kind="stable")
    # made nodes come in the order of their masses, so the two least stand at the heads of two queues
    leaf, total, kids = [*mass[order].tolist(), np.inf], [], np.empty((max(n - 1, 0), 2), np.int32)
    i = j = 0
    for k in range(n - 1):
        two, m = [], 0.0
        for _ in range(2):
            if j == k or leaf[i] <= total[j]:
                two.append(order[i])
                m, i = m + leaf[i], i + 1
            else:
                two.append(n + j)
                m, j = m + total[j], j + 1
        kids[k] = two
        total.append(m)
    return np.concatenate([mass, total]), kids


class Code:
    """A Huffman code: for each symbol its nodes and bits, and the log2 of what is left below a pruned branch."""

    def __init__(self, counts: np.ndarray, least: float = 0.0):
        # arrays, not tuples: the driver makes the code of all head words
        n = len(counts)
        mass, kids = _merged(np.maximum(counts, 1).astype(float))
        levels, depth, above, kept = [np.arange(len(mass))[len(mass) - 1 :]], np.zeros(len(mass), np.int32), np.zeros(len(mass)), np.zeros(len(mass), bool)
        floor = least * mass[-1] if n else 0.0
        while len(inner := levels[-1][levels[-1] >= n]):
            cut = (above[inner] > 0) | (mass[inner] < floor)
            over = np.where(above[inner] > 0, above[inner], np.where(cut, mass[inner], 0.0))
            kept[inner] = ~cut
            for child in kids[inner - n].T:
                depth[child], above[child] = depth[inner] + ~cut, over
            levels.append(kids[inner - n].ravel())
        # nodes are numbered from the root on, the right branch of each first
        within = kept.astype(np.int32)
        for level in levels[-2::-1]:
            inner = level[level >= n]
            within[inner] += within[kids[inner - n]].sum(1, dtype=np.int32)
        node, parent = np.zeros(len(mass), np.int32), np.full(len(mass), -1, np.int32)
        for level in levels[:-1]:
            inner = level[level >= n]
            left, right = kids[inner - n].T
            node[right] = node[inner] + 1
            node[left] = node[right] + within[right]
            parent[left], parent[right] = inner, inner
        inner = np.flatnonzero(kept)
        inner = inner[np.argsort(node[inner])]
        left, right = kids[inner - n].T
        self.prior = np.log(mass[right] / mass[left]).astype(np.float32) if len(inner) else np.zeros(1, np.float32)
        #: Each node's class of depth.
        self.shallow = np.minimum(3, depth[inner] // 3).astype(np.intp) if len(inner) else np.zeros(1, np.intp)
        self.rest = np.log2(np.divide(mass[:n], above[:n], out=np.ones(n), where=above[:n] > 0))
        self.length = depth[:n]
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int32)
        self.flat = np.empty(int(self.offset[-1]), np.uint32)
        symbol = at = np.flatnonzero(self.length)
        while len(symbol):  # from the leaves up
            up = parent[at]
            on = kept[up]
            self.flat[self.offset[symbol[on]] + depth[up[on]]] = node[up[on]] * 2 + (kids[up[on] - n, 1] == at[on])
            more = parent[up] >= 0
            symbol, at = symbol[more], up[more]

    def events(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in symbols, node, bit) of every bit of the symbols, in order. Places and nodes index arrays, so they are intp."""
        n = self.length.take(symbols)
        begin = np.cumsum(n, dtype=np.intp) - n
        at = np.repeat(np.arange(len(symbols)), n)
        code = self.flat.take(np.arange(len(at)) + np.repeat(self.offset.take(symbols) - begin, n), mode="clip")
        return at, (code >> np.uint32(1)).astype(np.intp), (code & np.uint32(1)).astype(np.int8)


# -- tables of hashed contexts ------------------------------------------------

def slots(node: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (context ^ node.astype(np.uint32) * _M1) * _M2
        h ^= h >> np.uint32(15)
        h *= _M1
        h >>= np.uint32(32 - bits)
    return h.astype(np.intp)


def table_bits(n: int, bounds: tuple[int, int]) -> int:
    return min(max(bounds[0], n.bit_length() + 1), bounds[1])


def _packed(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as 16 bits each; larger ones in proportion."""
    n = counts.reshape(-1, 2)
    top = np.maximum(n.max(1), 1)
    if top.max() > 65535:
        n = np.where((top > 65535)[:, None], np.maximum(np.minimum(n, 1), n * (65535 / top)[:, None]), n)
    n = n.astype(np.uint32)
    return n[:, 0] | n[:, 1] << np.uint32(16)


_PIECES = "name int, piece int, task int, kind string, data binary"
#: What tasks add up beside the tables: the mixer's state.
_MIXER = -1


def _rows(parts) -> "object":
    """Rows of _PIECES from (name, piece, array)."""
    import pyarrow as pa
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for name, piece, a in parts:
        if a.dtype.kind != "f":
            a = a.astype("<u2" if a.max() < 65536 else "<u4" if a.max() < 1 << 32 else "<u8")
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([piece], pa.int32()), pa.array([task], pa.int32()), pa.array([a.dtype.str]), pa.array([pa.compress(a.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["name", "piece", "task", "kind", "data"])


def _added(parts: DataFrame, last: bool) -> DataFrame:
    """The sums of equal (name, piece, task); at last tables come out packed, as they are used."""

    def run(batches):
        import pyarrow as pa

        now, total = None, None

        def done():
            out = total if last and now[0] == _MIXER else _packed(total) if last else total if total.dtype.kind == "f" else total.astype("<u4" if total.max() < 1 << 32 else "<u8")
            data = pa.compress(out.tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([now[2]], pa.int32()), pa.array([out.dtype.str]), pa.array([data], pa.binary())], names=["name", "piece", "task", "kind", "data"])

        for batch in batches:
            for name, piece, task, kind, data, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                here = np.frombuffer(pa.decompress(data, size, codec="zstd"), kind)
                if (name, piece, task) != now:
                    if now is not None:
                        yield done()
                    now, total = (name, piece, task), np.zeros(len(here), np.float64 if here.dtype.kind == "f" else np.int64)
                total += here
        if now is not None:
            yield done()

    order = ["name", "piece", "task"]
    sized = parts.withColumn("size", F.when(F.col("name") == _MIXER, F.lit(_State.SIZE * 8)).otherwise(F.substring("kind", 3, 1).cast("int") * F.col("width")))
    return sized.repartition(*order).sortWithinPartitions(*order).select("name", "piece", "task", "kind", "data", "size").mapInArrow(run, _PIECES)


def summed(parts: DataFrame, contexts: int, bits: int, scratch: Scratch) -> tuple[list[np.ndarray], np.ndarray | None]:
    """The packed tables (4 * 2**bits bytes each) and the sum of the mixers' states; a tree of sums of ``FAN`` parts."""
    size = min(PIECE, 1 << bits)
    sizes = F.lit(2 * size).alias("width")
    parts, level = scratch.save(parts, "parts0"), 0
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN:
        level += 1
        parts = scratch.save(_added(parts.withColumn("task", F.expr(f"task div {FAN}").cast("int")).withColumn("width", sizes), False), f"parts{level}")
        scratch.drop(f"parts{level - 1}")
        tasks = -(-tasks // FAN)
    import pyarrow as pa

    tables, state = [np.zeros(1 << bits, np.uint32) for _ in range(contexts)], None
    for r in _added(parts.withColumn("task", F.lit(0)).withColumn("width", sizes), True).collect():
        if r["name"] == _MIXER:
            state = np.frombuffer(pa.decompress(r["data"], _State.SIZE * 8, codec="zstd"), "<f8")
        else:
            tables[r["name"]][r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(pa.decompress(r["data"], 4 * size, codec="zstd"), "<u4")
    scratch.drop(f"parts{level}")
    return tables, state


class _State:
    """Sums that make a mixer: weights times evidence, evidence, outcomes of the last table."""

    GATES, INPUTS, STEPS = 256, 6, 33
    SIZE = GATES * INPUTS + GATES + 4 * STEPS * 2


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(np.minimum(z, 30)))


def _level(n: np.ndarray) -> np.ndarray:
    """ceil(log2(n + 1)), 7 at most, of whole numbers: the float32's exponent tells."""
    return np.clip((n.view(np.int32) >> 23) - 126, 0, 7)


class Mixer:
    """Gated logistic mixing of the predictions of a node's prior and its contexts, and the last table."""

    STEPS = _State.STEPS

    def __init__(self, code: Code, contexts: int):
        self.code = code
        # a row of weights for each input: the prior, the contexts, the bias
        self.weights = np.full((contexts + 2, _State.GATES), 0.6 / contexts, np.float32)
        self.weights[0], self.weights[-1] = 0.4, 0.0
        grid = (np.arange(self.STEPS) - self.STEPS // 2) / 2.0
        self.last = np.tile(grid.astype(np.float32), 4)
        # the node's prior within the counts of a context
        p = 1 / (1 + np.exp(-code.prior.astype(float)))
        self.one = (TRUST * p).astype(np.float32)

    def inputs(self, node, counts):
        """Logits by input, the gate of each bit, and the row of the last table; ``counts`` has (n0, n1) of each context."""
        x, one = [self.code.prior.take(node, mode="clip")], self.one.take(node, mode="clip")
        zero = np.float32(TRUST) - one
        gate = shallow = self.code.shallow.take(node, mode="clip")
        for k, (n0, n1) in enumerate(counts):
            x.append(np.log((n1 + one) / (n0 + zero)))
            if k >= len(counts) - 2:
                gate = gate * 8 + _level(n0 + n1)
        return x, gate, shallow * self.STEPS

    def logits(self, x, gate):
        z = self.weights[-1].take(gate, mode="clip")
        for w, v in zip(self.weights[:-1], x, strict=True):
            here = w.take(gate, mode="clip")
            here *= v
            z += here
        return np.clip(z, -12, 12, out=z)

    def refined(self, z, row):
        place = np.clip(z * np.float32(2) + np.float32(self.STEPS // 2), 0, self.STEPS - 1.001)
        low = place.astype(np.intp)
        part = place - low.astype(np.float32)
        low += row
        below = self.last.take(low, mode="clip")
        return (z + below + (self.last.take(low + 1, mode="clip") - below) * part) * np.float32(0.5)

    def costs(self, node, bit, counts) -> tuple[np.ndarray, np.ndarray]:
        """Nats of each bit by the mixture, and by the longest context sharpened (the mixture where it has no evidence)."""
        x, gate, row = self.inputs(node, counts)
        z = self.refined(self.logits(x, gate), row)
        n0, n1 = counts[-1]
        sharp = np.where(n0 + n1 > 0, x[-1] * np.float32(SHARPEN), z)
        sign = 1 - 2 * bit.astype(np.float32)
        return _softplus(z * sign), _softplus(sharp * sign)

    def trained(self, state: np.ndarray | None) -> "Mixer":
        """With the state that tasks have learnt; a gate without evidence keeps its weights."""
        if state is not None:
            n_inputs, gates = len(self.weights), _State.GATES
            n = state[gates * _State.INPUTS : gates * (_State.INPUTS + 1)]
            sums = state[: gates * _State.INPUTS].reshape(_State.INPUTS, gates)[:n_inputs]
            self.weights = np.where(n > 0, sums / np.maximum(n, 1), self.weights).astype(np.float32)
            out = state[-4 * self.STEPS * 2 :].reshape(-1, 2)
            prior = 1 / (1 + np.exp(-self.last.astype(float)))
            p = (out[:, 1] + 20 * prior) / (out.sum(1) + 20)
            self.last = np.log(p / (1 - p)).astype(np.float32)
        return self


class Learner:
    """A mixer and tables that learn online: predict, move the weights, count."""

    def __init__(self, code: Code, contexts: int, bits: int):
        self.mixer, self.bits = Mixer(code, contexts), bits
        self.tables = [np.zeros(2 << bits, np.int32) for _ in range(contexts)]
        self.squares = np.full(self.mixer.weights.shape, 1.0)
        self.seen, self.out = np.zeros(_State.GATES), np.zeros((4 * Mixer.STEPS, 2))

    def learn(self, node, bit, contexts) -> None:
        m, places = self.mixer, [slots(node, c, self.bits) for c in contexts]
        counts = []
        for table, at in zip(self.tables, places, strict=True):
            # both counts at once; int32 is what converts fast
            both = table.view(np.int64).take(at, mode="clip").view(np.int32)
            counts.append((both[0::2].astype(np.float32), both[1::2].astype(np.float32)))
        x, gate, row = m.inputs(node, counts)
        y = bit.astype(np.float32)
        for a in range(0, len(y), BATCH):
            s = slice(a, a + BATCH)
            here, g = [v[s] for v in x], gate[s]
            z = m.logits(here, g)
            at = np.clip(np.rint(z * 2 + m.STEPS // 2), 0, m.STEPS - 1).astype(np.intp) + row[s]
            self.out += np.bincount(at * 2 + bit[s], minlength=self.out.size).reshape(-1, 2)
            error = y[s] - 1 / (1 + np.exp(-z))
            for k, v in enumerate([*here, np.float32(1)]):
                gradient = np.bincount(g, error * v, minlength=_State.GATES)
                self.squares[k] += gradient * gradient
                m.weights[k] += (RATE * gradient / np.sqrt(self.squares[k])).astype(np.float32)
        self.seen += np.bincount(gate, minlength=_State.GATES)
        for table, at in zip(self.tables, places, strict=True):
            np.add.at(table, at * 2 + bit, np.int32(1))

    def parts(self):
        """(name, piece, array): the pieces of the tables that aren't empty, and the mixer's state."""
        for k, table in enumerate(self.tables):
            for p in range(0, len(table), 2 * PIECE):
                if (piece := table[p : p + 2 * PIECE]).any():
                    yield k, p // (2 * PIECE), piece
        if self.seen.any():
            weights = np.zeros((_State.INPUTS, _State.GATES))
            weights[: len(self.mixer.weights)] = self.mixer.weights * self.seen
            yield _MIXER, 0, np.concatenate([weights.ravel(), self.seen, self.out.ravel()])


def looked_up(tables: list[np.ndarray], places: list[np.ndarray], bit: np.ndarray, counted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n0, n1) of each context, without the bit itself where it was ``counted``."""
    out, own = [], np.where(counted, np.where(bit == 1, np.uint32(1 << 16), np.uint32(1)), np.uint32(0))
    for table, at in zip(tables, places, strict=True):
        v = table.take(at, mode="clip") - own
        out.append(((v & np.uint32(0xFFFF)).view(np.int32).astype(np.float32), (v >> np.uint32(16)).view(np.int32).astype(np.float32)))
    return out


# -- text to symbols ----------------------------------------------------------

def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)



class Head:
    """The head words (a list or an Arrow array), their counts and the word code."""

    def __init__(self, words, counts, ends: int, escaped: int):
        import pyarrow as pa

        self.counts = np.array(counts, np.int64)
        self.end, self.escape = len(words), len(words) + 1
        self.code = Code(np.array([*counts, ends, escaped]))
        #: Bits of each symbol by the tree's priors alone.
        self.prior_bits = np.empty(len(words) + 2)
        for a in range(0, len(words) + 2, 1 << 14):
            some = np.arange(a, min(a + (1 << 14), len(words) + 2))
            at, node, bit = self.code.events(some)
            cost = _softplus(self.code.prior.take(node) * (1 - 2 * bit.astype(np.float32)))
            self.prior_bits[some] = np.bincount(at, cost, len(some)) / np.log(2)
        data, offsets = text_bytes(pa.array(words, pa.large_string()))
        starts, ends_ = offsets[:-1], offsets[1:]
        self.table = ByteTable(max(1024, 1 << (4 * len(words)).bit_length()))
        self.table.add(data, starts, ends_, range_hashes(data, starts, ends_))


def _before(values: np.ndarray, opening: np.ndarray, back: int = 1) -> np.ndarray:
    """Each token's value ``back`` tokens before it in its document, 0 where there is none."""
    out = np.zeros_like(values)
    out[back:] = values[:-back]
    for k in range(back):
        at = opening + k
        out[at[at < len(out)]] = 0
    return out


def read(head: Head, column):
    """Tokens of a column of texts: (symbol, contexts, bounds by document, word index or -1, data, starts, ends)."""
    data, offsets = text_bytes(column)
    data = lower(data)
    starts, ends, first = word_bounds(data, offsets)
    hashes = range_hashes(data, starts, ends)
    n_docs, n = len(offsets) - 1, len(hashes)
    bounds = first + np.arange(n_docs + 1)
    word = np.full(n + n_docs, -1, np.int64)
    word[np.arange(n) + np.repeat(np.arange(n_docs), np.diff(first))] = np.arange(n)
    is_word = word >= 0
    symbol = np.full(n + n_docs, head.end, np.int32)
    found = head.table.find(data, starts, ends, hashes)
    symbol[is_word] = np.where(found < 0, head.escape, found)
    own = np.zeros(n + n_docs, np.uint32)
    own[is_word] = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    opening, every = bounds[:-1], np.arange(len(symbol))
    doc_start = np.repeat(opening, np.diff(bounds))
    # the last two common words before each token, within its document
    latest = _before(np.maximum.accumulate(np.where(is_word & (symbol < COMMON), every + 1, 0)), opening)
    latest[latest <= doc_start] = 0
    earlier = np.where(latest > 0, latest[latest - 1], 0)
    common = np.concatenate([[0], symbol + 1]).astype(np.uint32)
    last, two = _before(own, opening), _before(own, opening, 2)
    with np.errstate(over="ignore"):
        first_context = (common[latest] * np.uint32(COMMON + 1) + common[earlier] + np.uint32(1)) * _M2
        two[~_before(symbol < FREQUENT, opening)] = 0
        contexts = [first_context, mix32(last * _M1 ^ two * _M2) + np.uint32(11)]
    return symbol, contexts, bounds, word, data, starts, ends


def spelling(words: list[bytes]):
    """Bytes of words, each with a space as its end: (symbol, contexts, word)."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    lengths = np.array([len(w) + 1 for w in words])
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(data)) - (np.cumsum(lengths) - lengths)[word]
    back = []
    for k in range(1, 5):
        b = np.zeros(len(data), np.uint32)
        b[k:] = data[:-k]
        back.append(np.where(place >= k, b, 0).astype(np.uint32))
    with np.errstate(over="ignore"):
        two = back[0] * np.uint32(257) + back[1] + np.uint32(1)
        three = two * np.uint32(257) + back[2]
        four = three * np.uint32(257) + back[3]
        return data.astype(np.int32), [mix32(c + np.uint32(k * 977)) for k, c in enumerate((two, three, four))], word


def mix32(h: np.ndarray) -> np.ndarray:
    return (mix(h.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _parts(batch, size: int = 1 << 20):
    """Slices of a batch of about ``size`` bytes of text (its last column)."""
    import pyarrow.compute as pc

    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + size)))
        yield batch.slice(a, z - a)
        a = z


# -- the corpus ---------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; each task sums before the shuffle."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                if t:
                    held.update(t.lower().split())
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def top_words(counts: DataFrame, most: int) -> tuple["object", np.ndarray]:
    """At most ``most`` of the most frequent words, as an Arrow array, and their counts: those above a threshold that a small histogram gives."""
    import pyarrow as pa

    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    left, least = most, None
    counts = counts.where("c > 1")  # a word seen once stands for those not seen: it is spelt
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    if least is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    # as Arrow, not as rows: the driver holds all of them
    found = counts.where(level >= least).select("word", "c").toArrow().combine_chunks()
    found = found.sort_by([("c", "descending"), ("word", "ascending")])
    return found.column("word").combine_chunks(), found.column("c").to_numpy()


def head_words(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """``top_words`` as pairs."""
    words, c = top_words(counts, most)
    return list(zip(words.to_pylist(), c.tolist(), strict=True))


class Scorer:
    """Log2 probabilities of tokens under a trained mixer, adapting within each document."""

    #: Tokens of a step, so that its arrays stay in a core's cache.
    STEP = 1 << 12

    def __init__(self, head: Head, mixer: Mixer, tables: list[np.ndarray], bits: int):
        self.head, self.mixer, self.tables, self.bits = head, mixer, tables, bits

    def experts(self, symbol, contexts, counted) -> np.ndarray:
        """Bits of each token by the mixture, the priors and the sharpened context; the ``counted`` are taken out first."""
        out = np.empty((3, len(symbol)))
        out[1] = self.head.prior_bits[symbol]
        for a in range(0, len(symbol), self.STEP):
            s = slice(a, min(a + self.STEP, len(symbol)))
            at, node, bit = self.head.code.events(symbol[s])
            places = [slots(node, c[s].take(at, mode="clip"), self.bits) for c in contexts]
            costs = self.mixer.costs(node, bit, looked_up(self.tables, places, bit, counted[s].take(at, mode="clip")))
            for row, cost in ((0, costs[0]), (2, costs[1])):
                out[row, s] = np.bincount(at, cost, s.stop - s.start) / np.log(2)
        return out

    def bits_of(self, symbol, contexts, bounds, trained) -> np.ndarray:
        """Bits of each document; ``trained`` tells which were learnt from."""
        bits = adapted(self.experts(symbol, contexts, np.repeat(trained, np.diff(bounds))), bounds) - self.head.code.rest[symbol]
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return np.bincount(doc, bits, len(bounds) - 1)


#: How much each expert is trusted at a document's begin.
_FIRST = np.log(np.array([0.8, 0.1, 0.1]))


def adapted(costs: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bits of each token by experts weighted by their bits over the ``window`` tokens before it in its document."""
    n, ln2 = costs.shape[1], np.float32(np.log(2))
    total = np.concatenate([np.zeros((len(costs), 1)), np.cumsum(costs, axis=1)], axis=1)
    since = np.maximum(np.repeat(bounds[:-1], np.diff(bounds)), np.arange(n) - window)
    weight = [f - (t[:-1] - t.take(since, mode="clip")).astype(np.float32) * ln2 for f, t in zip(_FIRST.astype(np.float32), total, strict=True)]
    here = [w - c.astype(np.float32) * ln2 for w, c in zip(weight, costs, strict=True)]
    return (_logsum(weight) - _logsum(here)) / np.log(2)


def _logsum(parts: list[np.ndarray]) -> np.ndarray:
    top = parts[0]
    for p in parts[1:]:
        top = np.maximum(top, p)
    return top + np.log(sum(np.exp(p - top) for p in parts))


def _learnt(rows: DataFrame, shared, contexts: int, bits: int, symbols) -> DataFrame:
    """The parts of tables and mixers that tasks learn online; ``symbols(model, column)`` yields chunks of (symbol, contexts)."""

    def run(batches):
        code, learner = shared.value["code"], None
        for batch in batches:
            for part in _parts(batch):
                for symbol, context in symbols(shared.value, part.column(0)):
                    learner = learner or Learner(code, contexts, bits)
                    at, node, bit = code.events(symbol)
                    if len(at):
                        learner.learn(node, bit, [c.take(at, mode="clip") for c in context])
        if learner:
            yield from _rows(learner.parts())

    return rows.mapInArrow(run, _PIECES)


def _word_chunks(model: dict, column):
    symbol, contexts, *_ = read(model["head"], column)
    for a in range(0, len(symbol), 1 << 12):
        s = slice(a, a + (1 << 12))
        yield symbol[s], [c[s] for c in contexts]


def _letter_chunks(model: dict, column):
    words = [w.encode() for w in column.to_pylist()]
    for a in range(0, len(words), 4096):
        symbol, contexts, _ = spelling(words[a : a + 4096])
        yield symbol, contexts


def _letters(words: DataFrame) -> np.ndarray:
    """How often each byte comes, over all words, their ends as spaces; 256 sums."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(256, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column(0))
            n += np.bincount(data, minlength=256)
            n[32] += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["byte", "n"])

    out = np.ones(256)
    for r in words.select("word").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] += r["n"]
    return out


def train(docs: DataFrame, is_train: Column, scratch: Scratch) -> tuple[dict, DataFrame]:
    """The model (of bounded size) and the table of all training words' counts."""
    spark: SparkSession = docs.sparkSession
    learn = docs.where(is_train).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = scratch.save(word_counts(learn), "counts")
    ends = learn.count()
    words, often = top_words(counts, HEAD)
    lowest = int(often[-1]) if len(often) else None
    few = (F.col("c") > 1) & (F.col("c") <= (lowest or 0))
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.coalesce(F.sum(F.when(few, F.col("c"))), F.lit(0)).alias("few")).first()
    # Good and Turing: new words come as often as words seen once did, words seen r times as those seen r + 1 times
    seen, once = total["few"], total["once"]
    head = Head(words, often, ends, seen + once + 1)
    rest = total["n"] - int(often.sum())

    def fitted(name, rows, code, contexts, bits, symbols, **more):
        shared = spark.sparkContext.broadcast({"code": code, **more})
        tables, state = summed(_learnt(rows, shared, contexts, bits, symbols), contexts, bits, scratch)
        shared.destroy()  # the driver's copy too: the parts are written
        return {name: (Mixer(code, contexts).trained(state), tables, bits)}

    single = counts.where("c = 1").select("word")
    letters = _letters(single)
    model = fitted("words", learn, head.code, 2, table_bits(total["n"] + ends, WORD_BITS), _word_chunks, head=head)
    model |= fitted("spell", single, Code(letters), 3, table_bits(int(letters.sum()), SPELL_BITS), _letter_chunks)
    n = total["n"] + ends
    model |= {"head": head, "n": n, "v": total["v"] + (1 if ends else 0), "ends": ends, "rest": max(rest, 1), "new": (once + 1) / (seen + once + 2)}
    return model, counts


def score(docs: DataFrame, is_train: Column, held: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelt_score, bits_per_byte) of every whole text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    model, counts = train(docs, is_train, scratch)
    shared = spark.sparkContext.broadcast(model)
    n, v = model["n"], model["v"]
    schema = "uid long, doc_id long, held_out boolean, trained boolean, n_tokens long, n_known long, base double, bits double, bytes long, word string, n long"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        m = shared.value
        head, scorer = m["head"], Scorer(m["head"], *m["words"])
        seen = np.concatenate([head.counts, [m["ends"], 0]])
        base = np.log10((seen + 1.0) / (m["n"] + m["v"] + 1.0))
        base[head.escape] = 0.0  # rare words are added through the join
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _parts(batch):
                symbol, contexts, bounds, word, data, starts, ends = read(head, part.column(3))
                k = part.num_rows
                trained = part.column(2).to_numpy(zero_copy_only=False)
                bits = scorer.bits_of(symbol, contexts, bounds, trained)
                doc = np.repeat(np.arange(k), np.diff(bounds))
                ids = np.arange(uid, uid + k)
                uid += k
                lengths = np.bincount(doc, np.where(word >= 0, (ends - starts)[word] if len(starts) else 0, 0) + 1, k)
                none = pa.nulls(k)
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column(0), part.column(1), part.column(2), pa.array(np.diff(bounds)), pa.array(np.bincount(doc, seen[symbol] > 0, k).astype(np.int64)), pa.array(np.bincount(doc, base[symbol], k)), pa.array(bits), pa.array(lengths.astype(np.int64)), none.cast(pa.string()), none.cast(pa.int64())], names=_NAMES)
                rare = np.flatnonzero(symbol == head.escape)
                if len(rare):
                    raw = data.tobytes()
                    found = Counter(zip(doc[rare].tolist(), [raw[a:z] for a, z in zip(starts[word[rare]].tolist(), ends[word[rare]].tolist(), strict=True)], strict=True))
                    at, null = [d for d, _ in found], pa.nulls(len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), null.cast(pa.int64()), null.cast(pa.bool_()), pa.array(trained[at]), null.cast(pa.int64()), null.cast(pa.int64()), null.cast(pa.float64()), null.cast(pa.float64()), null.cast(pa.int64()), pa.array([w.decode() for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=_NAMES)

    text = F.coalesce("text", F.lit("")).alias("text")
    passed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(is_train, F.lit(False)).alias("trained"), text).mapInArrow(run, schema)
    both = scratch.save(passed, "scored")
    rare = both.where("word IS NOT NULL").select("uid", "word", "n", "trained")

    def spell(batches):
        """Bits of the spelling of each different word that is new to some text; equal words come one after another."""
        import pyarrow as pa

        mixer, tables, bits = shared.value["spell"]
        last: dict = {}
        for batch in batches:
            needed = np.flatnonzero(batch.column(3).to_numpy() <= 0)
            cost = np.zeros(batch.num_rows)
            for a in range(0, len(needed), 8192):
                at = needed[a : a + 8192]
                words, c = (batch.column(k).take(pa.array(at)).to_pylist() for k in (1, 2))
                new = {w: k == 1 for w, k in zip(words, c, strict=True) if w not in last}
                known = last | (dict(zip(new, spelt_bits(mixer, tables, bits, list(new), np.array(list(new.values()))).tolist(), strict=True)) if new else {})
                cost[at] = [known[w] for w in words]
                last = {words[-1]: known[words[-1]]}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(2), batch.column(3), pa.array(cost)], names=["uid", "n", "c", "others", "bits"])

    c = F.coalesce("c", F.lit(0))
    # a training text's own words don't count
    others = F.when(F.col("trained"), c - F.col("n")).otherwise(c)
    joined = rare.join(counts, "word", "left").withColumns({"c": c, "others": others}).sortWithinPartitions("word")
    # the letters of words that others have needn't be sent
    joined = joined.select("uid", F.when(F.col("others") <= 0, F.col("word")).alias("word"), "c", "others", "n")
    spelt = joined.mapInArrow(spell, "uid long, n long, c long, others long, bits double")
    chosen = F.when(F.col("others") > 0, (1 - model["new"]) * F.col("others") / model["rest"]).otherwise(F.lit(model["new"]))
    spelt = spelt.withColumn("token", F.log2(chosen)).withColumn("bits", F.col("token") - F.col("bits"))
    added = spelt.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("more_base"), F.sum(F.col("n") * F.col("bits")).alias("more_bits"), F.sum(F.col("n") * F.col("token")).alias("more_tokens"))
    whole = both.where("word IS NULL").join(added, "uid", "left")
    bits, tokens = (F.col("bits") - F.coalesce(c, F.lit(0.0)) for c in ("more_bits", "more_tokens"))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (-tokens * float(np.log10(2))).alias("score"), (-bits * float(np.log10(2))).alias("spelt_score"), (bits / F.col("bytes")).alias("bits_per_byte"),
    )


def spelt_bits(mixer: Mixer, tables: list[np.ndarray], bits: int, words: list[str], counted: np.ndarray) -> np.ndarray:
    """Bits of the spelling of each word; those ``counted`` by the speller are taken out."""
    symbol, contexts, word = spelling([w.encode() for w in words])
    at, node, bit = mixer.code.events(symbol)
    of = word.take(at)
    places = [slots(node, c.take(at), bits) for c in contexts]
    cost, _ = mixer.costs(node, bit, looked_up(tables, places, bit, counted.take(of)))
    return np.bincount(of, cost, len(words)) / np.log(2)


_NAMES = ["uid", "doc_id", "held_out", "trained", "n_tokens", "n_known", "base", "bits", "bytes", "word", "n"]
