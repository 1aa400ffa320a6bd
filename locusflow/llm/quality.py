"""Quality classifier: naive Bayes support vectors.

Features are n-gram indicators (whether a text has the n-gram, not how often)
of words (one and two) and bytes (three and four), hashed to 2**20 places, and
three for a word that comes two, three or four times in a row, whichever word.
Each indicator is scaled by its class log-count ratio

    r = log((p / |p|) / (q / |q|))

where p and q are the documents of each class that have it, each smoothed by
one document split as the classes are, so an n-gram never seen has ratio 0,
and a linear model with hinge loss is fitted to the scaled, length-normalised
indicators by dual coordinate descent. A sigmoid fitted to margins of
cross-validation turns margins into scores.

The model is fitted in one task on at most ``FIT_ROWS`` labelled documents, a
stated bound; scoring covers every whole text.

Defined results: a null or empty text has no feature and gets the score of the
bias alone; equal texts get equal scores; labels other than 0 and 1 are
ignored; without training rows of both classes every score is the share of
label 1 (0.5 without any); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, mix, platt, text_bytes, word_hashes

FIT_ROWS = 6000
BITS = 20
#: The places of the indicators of a word twice, three and four times in a row.
_AGAIN = np.array([1, 2, 3], np.int32)


def indicators(data: np.ndarray, offsets: np.ndarray):
    """Yield each text's distinct feature places (int32)."""
    words, starts, ends, first = word_hashes(data, offsets)
    mask = np.uint64((1 << BITS) - 1)
    with np.errstate(over="ignore"):
        one = (mix(words ^ np.uint64(0x51)) & mask).astype(np.int32)
        two = (mix(words[:-1] * np.uint64(3) + words[1:]) & mask).astype(np.int32)
        b = data.astype(np.uint32)
        three = b[:-2] | b[1:-1] << 8 | b[2:] << 16 if len(b) > 2 else np.zeros(0, np.uint32)
        four = three[:-1] ^ b[3:] << 24 if len(b) > 3 else np.zeros(0, np.uint32)
        three = (three * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32)
        four = (((four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int32)
        same = words[1:] == words[:-1]
    seen = np.zeros(1 << BITS, np.int32)
    for i in range(len(offsets) - 1):
        a, z, f, l = offsets[i], offsets[i + 1], first[i], first[i + 1]
        r = same[f : max(f, l - 1)]
        again = [r.any(), (r[1:] & r[:-1]).any(), (r[2:] & r[1:-1] & r[:-2]).any()]
        ids = np.concatenate([one[f:l], two[f : max(f, l - 1)], three[a : max(a, z - 2)], four[a : max(a, z - 3)], _AGAIN[again]])
        place = np.arange(len(ids), dtype=np.int32)
        seen[ids] = place
        yield ids[seen[ids] == place]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    size = np.array([(labels <= 0).sum(), (labels > 0).sum()], float)[:, None]
    counts = np.zeros((2, 1 << BITS)) + size / size.sum()
    for ids, y in zip(rows, labels, strict=True):
        counts[int(y > 0)][ids] += 1
    q, p = counts / size
    return np.log(p / q).astype(np.float32)


def dual_coordinate_descent(rows, values, labels, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + sum cost_i * max(0, 1 - y_i (w x_i + b)).

    One dual variable moves at a time to its optimum within [0, cost_i]; the
    bias is one more feature, of value 1.
    """
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            y = labels[i]
            gradient = y * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                w[rows[i]] += step * y * values[i]
                bias += step * y
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, bias


def scaled(ids: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The scaled indicators of a text at unit length."""
    v = r[ids]
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(r, w, bias, a, b): score = sigmoid(a * (w . scaled + bias) + b)."""
    size, y = 1 << BITS, np.where(labels > 0, 1.0, -1.0)
    share = {s: max(1, int((y == s).sum())) for s in (-1.0, 1.0)}
    cost = np.array([len(y) / (2 * share[s]) for s in y])

    def trained(part):
        r = log_count_ratios([rows[i] for i in part], labels[part])
        x = [scaled(rows[i], r) for i in part]
        return r, *dual_coordinate_descent([rows[i] for i in part], x, y[part], size, cost[part])

    margins = np.zeros(len(y))
    of = np.random.default_rng(7).integers(0, folds, len(y))
    for k in range(folds):
        part, rest = np.flatnonzero(of != k), np.flatnonzero(of == k)
        r, w, bias = trained(part)
        for i in rest:
            margins[i] = float(w[rows[i]] @ scaled(rows[i], r)) + bias
    a, b = platt(margins, y)
    r, w, bias = trained(np.arange(len(y)))
    return r, w, bias, a, b


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality", fit_rows: int = FIT_ROWS) -> dict:
    """Fit in one task on the bounded sample; the model comes back as a few MB."""

    def run(batches):
        import pyarrow as pa

        rows, ys = [], []
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            rows += indicators(data, offsets)
            ys += batch.column(1).to_pylist()
        y = np.array(ys)
        if len(set(ys)) < 2:
            model = [np.zeros(0, np.float32)] * 2 + [0.0, 0.0, 0.0]
            share = float(y.mean()) if len(y) else 0.5
        else:
            model, share = fit(rows, y), 0.5
        yield pa.RecordBatch.from_pydict({"r": [model[0].astype("<f4").tobytes()], "w": [model[1].astype("<f4").tobytes()], "rest": [[float(x) for x in model[2:]] + [share]]})

    sample = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, train_rows, fit_rows)
    got = sample.select("doc_id", "text", "label").repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label").mapInArrow(run, "r binary, w binary, rest array<double>").first()
    if got is None:
        return {"r": np.zeros(0, np.float32), "w": np.zeros(0, np.float32), "rest": [0.0, 0.0, 0.0, 0.5]}
    return {"r": np.frombuffer(got["r"], "<f4"), "w": np.frombuffer(got["w"], "<f4"), "rest": list(got["rest"])}


def score(docs: DataFrame, model: dict, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of docs and the score (``name``) of every whole text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, own = docs.select(*columns), "text" in columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), f"`{name}` double"])
    width, text_at = len(columns), columns.index("text") if own else len(columns)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        bias, a, b, share = m["rest"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data, offsets = text_bytes(part.column(text_at))
                out = np.full(part.num_rows, share)
                if len(m["w"]):
                    for i, ids in enumerate(indicators(data, offsets)):
                        v = m["r"][ids]
                        norm = float(np.sqrt(np.dot(v, v)))
                        out[i] = a * ((float(np.dot(m["w"][ids], v)) / norm if norm else 0.0) + bias) + b
                    out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(out)], names=[*columns, name])

    return (kept if own else docs.select(*columns, F.col("text").alias("_text"))).mapInArrow(run, schema)
