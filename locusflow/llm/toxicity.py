"""Toxicity: a support vector machine on a subsequence string kernel, with Nystroem landmarks.

The kernel of two units (words, or runs of single letters joined) is the
gap-weighted subsequence kernel of order 3: each subsequence of three letters
counts LAMBDA ** (the letters and gaps it spans), so inserted characters weaken
a match but don't break it. It is normalised to 1 for equal units.

Learning is from labelled sentences of at most ``FIT_ROWS`` labelled documents
(a stated bound), in rounds. A sentence of an untoxic document is a negative.
Of a toxic document the sentence that the machine so far likes most is the
positive, by its most toxic unit, its witness; its other sentences are
negatives where the machine says so, and a document all of whose sentences it
rejects is taken for mislabelled. A witness weighs by the documents that have it
or one like it (by the kernel). The machine works on Nystroem features
K(z,z)^(-1/2) k(z, unit) of landmarks z drawn from both classes; its scores are
calibrated on documents that it didn't learn from. What a fit takes of the
sentences is bounded by ``POSITIVES``, ``FREQUENT``, ``RANDOM``, ``HARD`` and ``MOST``.

The decision is linear in k(z, unit), and the kernel is a sum over
subsequences. So scoring needs no landmark: the sum over landmarks is taken
once, for each of the 2**18 subsequences, and a unit's decision is the sum of
its own subsequences' entries, which is the same number.

A text's score is the sigmoid of its most toxic unit's decision. Every unit of
every whole text counts.

Defined results: a null or empty text has no unit and gets the least score of
the model; equal texts get equal scores; labels other than 0 and 1 are ignored;
without training rows of both classes every score is the share of label 1 (0
without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, platt
from .quality import dual_coordinate_descent

FIT_ROWS = 6000
LANDMARKS = 192
LAMBDA = 0.6
#: Letters are hashed to 6 bits, so subsequences of three to 18.
CODES = 1 << 18
#: A longer unit is cut into windows of so many characters, half overlapping.
WINDOW = 16
#: Bounds of what a machine is fitted on: witnesses of toxic sentences; units of others that are most frequent, drawn at
#: random, most mistaken in a round; all of others.
POSITIVES, FREQUENT, RANDOM, HARD, MOST = 1500, 600, 2500, 600, 8000
#: Of a slack of one; and how many other documents make a witness count in full.
COST, TRUST = 40.0, 1.0
#: Units whose decisions a Python worker remembers.
MEMO = 1_000_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s+){2,}[^\W\d_](?!\S)")
_OUTER = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&-_/\\+=~`"


def units(text: str) -> set[str]:
    """The distinct units of a text: its words in lower case without outer marks, and letters spaced out as one word."""
    text = text.lower()
    found = {w.strip(_OUTER) for w in set(text.split())}
    if _SPACED.search(text):
        found.update("".join(m.split()).strip(_OUTER) for m in _SPACED.findall(text))
    found.discard("")
    return found


def windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


_TRIPLES = {n: np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3).T for n in range(WINDOW + 1)}
_WEIGHTS = {n: (LAMBDA ** (t[2] - t[0] + 1.0)).astype(np.float32) for n, t in _TRIPLES.items()}


def letter_codes(words: list[str], width: int) -> np.ndarray:
    """One row a word: a 6-bit code a letter, -1 for what is no letter. The words have ``width`` characters each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.int64)
    letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
    return np.where(letter, np.where(points < 128, points - 97, 26 + points % 38), -1)


def subsequences(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights): one row a word, a column for each three places; weight 0 where one is no letter."""
    codes, t = letter_codes(words, width), _TRIPLES[width]
    a, b, c = codes[:, t[0]], codes[:, t[1]], codes[:, t[2]]
    fine = (a >= 0) & (b >= 0) & (c >= 0)
    return np.where(fine, a << 12 | b << 6 | c, 0), np.where(fine, _WEIGHTS[width], np.float32(0))


def self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """k(w, w) of each row: equal subsequences of a word add up before squaring."""
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1).astype(np.float64)
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    if not c.size:
        return np.zeros(len(c))
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, w.ravel())
    return np.bincount(np.repeat(np.arange(len(c)), new.sum(1)), sums**2, len(c))


def explicit(word: str) -> dict[int, float]:
    """The normalised feature map of one window, as {subsequence: weight}."""
    codes, weights = subsequences([word], len(word))
    out: dict[int, float] = {}
    for c, w in zip(codes[0].tolist(), weights[0].tolist(), strict=True):
        if w:
            out[c] = out.get(c, 0.0) + w
    norm = sum(v * v for v in out.values()) ** 0.5
    return {c: v / norm for c, v in out.items()}


def decisions(words: list[str], table: np.ndarray) -> np.ndarray:
    """sum over subsequences of weight * table[code], normalised; windows of up to WINDOW characters."""
    out = np.zeros(len(words))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        if n < 3:
            continue
        step = max(1, 400_000 // _TRIPLES[n].shape[1])
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            codes, weights = subsequences([words[i] for i in part], n)
            total, own = (table[codes] * weights).sum(1), self_kernel(codes, weights)
            out[part] = np.divide(total, np.sqrt(own), out=np.zeros(len(part)), where=own > 0)
    return out


def unit_decisions(found: list[str], table: np.ndarray) -> np.ndarray:
    """Each unit's largest decision over its windows."""
    parts = [windows(u) for u in found]
    flat = decisions([w for p in parts for w in p], table)
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return np.maximum.reduceat(flat, starts) if len(found) else np.zeros(0)


class Machine:
    """Nystroem features of landmarks and the hinge-loss weights on them, collapsed to a table."""

    def __init__(self, landmarks: list[str]):
        maps = [explicit(z) for z in landmarks]
        self.phi = np.zeros((CODES, len(maps)), np.float32)
        for j, m in enumerate(maps):
            for c, v in m.items():
                self.phi[c, j] = v
        gram = self.phi[np.unique([c for m in maps for c in m])].astype(np.float64)
        values, vectors = np.linalg.eigh(gram.T @ gram)
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    def features(self, words: list[str]) -> np.ndarray:
        maps = [explicit(w) for w in words]
        k = np.array([sum((self.phi[c] * v for c, v in m.items()), np.zeros(self.phi.shape[1])) for m in maps])
        return k.reshape(len(words), -1) @ self.root

    def fit(self, words: list[str], y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
        x, every = self.features(words), np.arange(self.root.shape[0])
        w, bias = dual_coordinate_descent([every] * len(words), list(x), y, len(every), cost, epochs=30)
        return (self.phi @ (self.root @ w)).astype(np.float32), bias


def support(words: list[str], documents: np.ndarray) -> np.ndarray:
    """For each window the documents of the others, each by its squared kernel with it, and the further ones of its own."""
    maps = [explicit(w) for w in words]
    places = {c: k for k, c in enumerate(sorted(set().union(*maps)))}
    x = np.zeros((len(maps), len(places)), np.float32)
    for i, m in enumerate(maps):
        x[i, [places[c] for c in m]] = list(m.values())
    return (x @ x.T) ** 2 @ documents - 1.0


def _odds(bags: list[list[set[str]]], labels: np.ndarray):
    """Documents of each class that have a unit, and a first decision: how surely a unit marks toxic documents."""
    df: list[dict[str, int]] = [{}, {}]
    for bag, y in zip(bags, labels, strict=True):
        for u in set().union(*bag):
            df[int(y > 0)][u] = df[int(y > 0)].get(u, 0) + 1
    n = [int((labels <= 0).sum()), int((labels > 0).sum())]
    ratio = {u: np.log((c + 0.5) / (n[1] + 1)) - np.log((df[0].get(u, 0) + 0.5) / (n[0] + 1)) for u, c in df[1].items()}
    return df, lambda found: np.array([ratio.get(u, -1.0) + 0.3 * np.log(df[1].get(u, 0) + 1) for u in found])


def _machine(bags: list[list[set[str]]], labels: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """(table, bias) learnt from sentences: those of untoxic documents are negatives, one of each toxic document is positive."""
    rng = np.random.default_rng(seed)
    df, decide = _odds(bags, labels)
    share = (labels > 0).sum() / max(1, (labels <= 0).sum())
    clean = sorted(df[0], key=lambda u: (-df[0][u], u))
    negatives = set(clean[:FREQUENT]) | {clean[i] for i in rng.choice(len(clean), min(len(clean), RANDOM), replace=False)}
    table, bias = np.zeros(CODES, np.float32), 0.0
    for step in range(rounds):
        witnesses: dict[str, int] = {}
        for bag, y in zip(bags, labels, strict=True):
            # the sentence of a toxic document that its unit marks most; the document's other sentences are negatives if they look so
            best = [(found, d) for found in map(sorted, bag) if found and y > 0 for d in [decide(found)]]
            if not best:
                continue
            top = max(range(len(best)), key=lambda k: best[k][1].max())
            found, d = best[top]
            unit = found[int(np.argmax(d))]
            # a unit that untoxic documents share is no evidence; a document whose best unit the machine rejects is taken for mislabelled
            if df[0].get(unit, 0) * share <= 0.2 * df[1].get(unit, 0) and (not step or d.max() + bias > 0):
                witnesses[unit] = witnesses.get(unit, 0) + 1
            if step:
                negatives |= {f[int(np.argmax(e))] for k, (f, e) in enumerate(best) if k != top and e.max() + bias < 0 and len(negatives) < MOST}
        positives = sorted(witnesses, key=lambda u: (-witnesses[u], u))[:POSITIVES]
        if step:  # the untoxic units that the machine likes most join the negatives
            d = unit_decisions(clean, table)
            negatives |= {clean[i] for i in np.argsort(-d, kind="stable")[:HARD]}
        if not positives:
            break
        # of a long unit the window that is most toxic so far, the first at the start
        windowed = [w[int(np.argmax(decisions(w, table)))] if len(w) > 1 else w[0] for w in map(windows, positives)]
        neg = [w for u in sorted(negatives - set(positives)) for w in windows(u)]
        chosen = sorted(set(windowed[: LANDMARKS // 2] + [windowed[i] for i in rng.integers(0, len(windowed), LANDMARKS // 4)]))
        chosen = chosen + [neg[i] for i in sorted(rng.choice(len(neg), min(len(neg), LANDMARKS - len(chosen)), replace=False))]
        machine = Machine([z for z in chosen if explicit(z)] or ["aaa"])
        # a witness weighs by how many documents have it or one like it, so a label's slip weighs little
        trust = np.minimum(1.0, support(windowed, np.array([witnesses[u] for u in positives])) / TRUST)
        cost = np.concatenate([COST * len(neg) / max(trust.sum(), 1.0) * (trust + 0.01), np.full(len(neg), COST)])
        table, bias = machine.fit(windowed + neg, np.array([1.0] * len(positives) + [-1.0] * len(neg)), cost)
        decide = lambda found, t=table: unit_decisions(found, t)
    return table, bias


def fit(texts: list[str], labels: np.ndarray, rounds: int = 3, seed: int = 3, folds: int = 2) -> tuple[np.ndarray, float, float, float]:
    """(table, bias, a, b) from labelled texts: score = sigmoid(a * (max decision, at least 0, + bias) + b).

    The sigmoid is fitted to decisions about texts that weren't learnt from.
    """
    bags = [[units(s) for s in _SENTENCE.split(t or "") if s] for t in texts]
    of, margins = np.random.default_rng(seed).integers(0, folds, len(bags)), np.zeros(len(bags))
    for k in range(folds):
        part, rest = np.flatnonzero(of != k), np.flatnonzero(of == k)
        if len(set(labels[part].tolist())) < 2:
            continue
        table, bias = _machine([bags[i] for i in part], labels[part], rounds, seed)
        for i in rest:
            margins[i] = max(unit_decisions(sorted(set().union(*bags[i])), table), default=0.0)
        margins[rest] = np.maximum(margins[rest], 0.0) + bias
    table, bias = _machine(bags, labels, rounds, seed)
    return table, bias, *platt(margins, np.where(labels > 0, 1.0, -1.0))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", fit_rows: int = FIT_ROWS) -> dict:
    """Fit in one task on the bounded sample; the model comes back as about 1 MB."""

    def run(batches):
        import pyarrow as pa

        texts, ys = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
        y = np.array(ys)
        if len(set(ys)) < 2:
            model, share = (np.zeros(0, np.float32), 0.0, 0.0, 0.0), float(y.mean()) if len(y) else 0.0
        else:
            model, share = fit(texts, y), 0.0
        yield pa.RecordBatch.from_pydict({"table": [model[0].tobytes()], "rest": [[float(x) for x in model[1:]] + [share]]})

    sample = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, train_rows, fit_rows)
    got = sample.select("doc_id", "text", "label").repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label").mapInArrow(run, "table binary, rest array<double>").first()
    if got is None:
        return {"table": np.zeros(0, np.float32), "rest": [0.0, 0.0, 0.0, 0.0]}
    return {"table": np.frombuffer(got["table"], "<f4"), "rest": list(got["rest"])}


#: A Python worker serves many tasks of one model; what it remembers stays.
_KNOWN: dict[int, dict[str, float]] = {}


def score(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``columns`` of docs and ``score`` of every whole text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, key = docs.select(*columns), hash(model["table"].tobytes())
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), "score double"])

    def run(batches):
        import pyarrow as pa

        table, (bias, a, b, share) = shared.value["table"], shared.value["rest"]
        if key not in _KNOWN:
            _KNOWN.clear()
        known = _KNOWN.setdefault(key, {})
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                if not len(table):
                    out = np.full(part.num_rows, share)
                else:
                    found = [units(t) if t else set() for t in part.column(part.num_columns - 1).to_pylist()]
                    if len(known) > MEMO:
                        known.clear()
                    new = list(set().union(*found).difference(known))
                    known.update(zip(new, unit_decisions(new, table).tolist(), strict=True))
                    top = np.array([max(map(known.__getitem__, f), default=0.0) for f in found])
                    out = 1 / (1 + np.exp(-np.clip(a * (np.maximum(top, 0.0) + bias) + b, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out)], names=[*columns, "score"])

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, schema)
