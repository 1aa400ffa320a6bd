"""The language model against slow twins, and held-out scores against the base."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusflow.llm import mixing_lm
from locusflow.llm.common import Scratch, held_out, range_hashes, table
from tests.llm.test_llm import ODD, docs_of, prose

def held():
    return held_out("doc_id", 7, 2)


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus():
    rows = [(i, prose(i % 50, 30 + i % 7) + (" Rare%dWord" % i if i % 4 == 0 else ""), "a") for i in range(400)] + ODD
    return rows + [(1000 + i, "x" * 3000 + " " + prose(i, 4), "a") for i in range(3)]


def test_base_and_score(spark):
    rows = corpus()
    got = mixing_lm.score(docs_of(spark, rows), ~held(), held()).collect()
    tokens = [((t or "").encode().lower().split() + [None]) for _, t, _ in rows]
    c = Counter(x for (i, *_), w in zip(rows, tokens, strict=True) if not is_held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, is_held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, *_), w in zip(rows, tokens, strict=True))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(0 > r["score"] and r["bits_per_byte"] > 0 for r in got)
    plain = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["score"] for r in plain) > sum(r["base_score"] for r in plain)


@pytest.mark.parametrize("keep", ["none", "all", "no training rows"])
def test_edges(spark, keep):
    docs = docs_of(spark, corpus()[-12:])
    docs = docs.limit(0) if keep == "none" else docs.where(held()) if keep == "no training rows" else docs
    got = mixing_lm.score(docs, ~held(), held()).collect()
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["bits_per_byte"]) for r in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_text_is_foretold_better_than_by_the_base(spark, sf):
    rows = mixing_lm.score(table(spark, f"/root/testdata/{sf}", "documents"), ~held(), held()).collect()
    kept = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)
    per_token = [sum(r["score"] for r in x) / sum(r["n_tokens"] for r in x) for x in (kept, [r for r in rows if not r["held_out"]])]
    assert abs(per_token[0] - per_token[1]) < 0.3  # training texts are scored without themselves


def test_a_text_that_occurs_twice_stands_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 500, 60)), "a") for i in range(200)]
    rows += [(200 + i, rows[i][1], "a") for i in range(10)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in mixing_lm.score(docs_of(spark, rows), ~held(), held()).collect()}
    twice = [got[i] for i in [*range(10), *range(200, 210)] if not is_held((i + 200) % 400)]  # whose other copy was learnt from
    assert max(twice) < min(got[i] for i in range(10, 200))


def slow_scores(model, rows):
    """Each text's bits as the word tree sees it, one bit after another, in plain numbers."""
    head, mixer, bits = model["head"], model["words"][0], model["words"][2]
    names = {w: k for k, w in enumerate(model["names"])}
    code = head.code

    def tokens(text):
        words = (text or "").encode().lower().split()
        own = [int(range_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 32 | 1 for w in words]
        symbols = [names.get(w.decode(), head.escape) for w in words] + [head.end]
        for k, symbol in enumerate(symbols):
            common = [s for s in symbols[:k] if s < mixing_lm.COMMON][::-1]
            a, b = (common[j] + 1 if j < len(common) else 0 for j in (0, 1))
            last, two = (own[k - j] if k >= j else 0 for j in (1, 2))
            if k and symbols[k - 1] >= mixing_lm.FREQUENT:
                two = 0
            yield symbol, a, b, last, two

    def events(text):
        for symbol, a, b, last, two in tokens(text):
            one = lambda x: np.array([x & 0xFFFFFFFF], np.uint32)
            m1, m2 = int(mixing_lm._M1), int(mixing_lm._M2)
            contexts = [one((a * (mixing_lm.COMMON + 1) + b + 1) * m2), one(int(mixing_lm.mix32(one((last * m1 ^ two * m2) & 0xFFFFFFFF))[0]) + 11)]
            path = code.flat[code.offset[symbol] : code.offset[symbol] + code.length[symbol]].tolist()
            yield symbol, [(x >> 1, x & 1, d, [int(mixing_lm.slots(np.array([x >> 1], np.uint32), c, bits)[0]) for c in contexts]) for d, x in enumerate(path)]

    counts = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for i, t, *_ in rows:
        if not is_held(i):
            for _, path in events(t):
                for _, bit, _, at in path:
                    for table_, s in zip(counts, at, strict=True):
                        table_[s][bit] += 1
    softplus = lambda z: math.log1p(math.exp(z))
    for i, t, *_ in rows:
        total, history = 0.0, []
        for symbol, path in events(t):
            cost = [0.0, 0.0, 0.0]
            for node, bit, depth, at in path:
                prior = float(code.prior[node])
                p = 1 / (1 + math.exp(-prior))
                gate, x = min(3, depth // 3), [prior]
                for k, s in enumerate(at):
                    n0, n1 = (counts[k][s][j] - (j == bit and not is_held(i)) for j in (0, 1))
                    x.append(math.log((n1 + mixing_lm.TRUST * p) / (n0 + mixing_lm.TRUST * (1 - p))))
                    gate = gate * 8 + min(7, math.ceil(math.log2(n0 + n1 + 1)))
                z = min(12, max(-12, float(mixer.weights[-1, gate]) + sum(float(w) * v for w, v in zip(mixer.weights[:-1, gate], x, strict=True))))
                steps = mixer.STEPS
                place = min(max(z * 2 + steps // 2, 0), steps - 1.001)
                low, row = int(place), min(3, depth // 3) * steps
                below, above = float(mixer.last[row + low]), float(mixer.last[row + low + 1])
                fine = (z + below + (above - below) * (place - low)) / 2
                sharp = mixing_lm.SHARPEN * x[-1] if n0 + n1 else fine
                for e, v in enumerate((fine, prior, sharp)):
                    cost[e] += softplus(-v if bit else v) / math.log(2)
            recent = [sum(h[e] for h in history[-mixing_lm.WINDOW :]) for e in range(3)]
            weight = [math.exp(f) * 2.0 ** (min(recent) - r) for f, r in zip(mixing_lm._FIRST, recent, strict=True)]
            total -= math.log2(sum(w * 2.0**-c for w, c in zip(weight, cost, strict=True)) / sum(weight)) + float(code.rest[symbol])
            history.append(cost)
        yield total


def test_scores_equal_a_slow_twin(spark):
    import pyarrow as pa

    rows = [(i, prose(i % 9, 20 + i % 5), "a") for i in range(40)] + [(50, "", "a"), (51, "one two", "a"), (52, prose(3, 60), "a")]
    docs = docs_of(spark, rows)
    model, counts = mixing_lm.train(docs, ~held(), Scratch(spark, "t"))
    model["names"] = [w for w, _ in mixing_lm.head_words(counts, mixing_lm.HEAD)]
    scorer = mixing_lm.Scorer(model["head"], *model["words"])
    symbol, contexts, bounds, *_ = mixing_lm.read(model["head"], pa.array([t for _, t, _ in rows]))
    trained = np.array([not is_held(i) for i, *_ in rows])
    want = list(slow_scores(model, rows))
    assert scorer.bits_of(symbol, contexts, bounds, trained) == pytest.approx(want, rel=2e-4)
    scorer.STEP = 7
    assert scorer.bits_of(symbol, contexts, bounds, trained) == pytest.approx(want, rel=2e-4)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    code = mixing_lm.Code(rng.integers(1, 500, 40), 2.0**-4)
    mixer = mixing_lm.Mixer(code, 3)
    mixer.weights = rng.normal(0.3, 0.3, mixer.weights.shape).astype(np.float32)
    tables = [rng.integers(0, 9, 256).astype(np.uint32) | rng.integers(0, 9, 256).astype(np.uint32) << np.uint32(16) for _ in range(3)]
    at, node, bit = code.events(np.arange(40))
    places = [mixing_lm.slots(node, np.full(len(at), k, np.uint32), 8) for k in (5, 6, 7)]
    for cost in mixer.costs(node, bit, mixing_lm.looked_up(tables, places, bit, np.zeros(len(at), bool))):
        assert np.exp2(code.rest - np.bincount(at, cost, 40) / np.log(2)).sum() == pytest.approx(1, abs=1e-4)
    p = rng.dirichlet(np.ones(4), (3, 6))  # six tokens, each of four symbols, under three experts
    bounds = np.array([0, 2, 6])
    for t in range(6):
        got = []
        for symbol in range(4):
            costs = -np.log2(p[:, np.arange(6), 0])
            costs[:, t] = -np.log2(p[:, t, symbol])
            got.append(2.0 ** -mixing_lm.adapted(costs, bounds, 3)[t])
        assert sum(got) == pytest.approx(1)


def test_sums_are_the_same_in_a_tree(spark, monkeypatch):
    docs = docs_of(spark, [(i, prose(i, 20), "a") for i in range(60)]).repartition(7, "doc_id")
    whole, _ = mixing_lm.train(docs, ~held(), Scratch(spark, "t"))
    monkeypatch.setattr(mixing_lm, "FAN", 2)
    tree, _ = mixing_lm.train(docs, ~held(), Scratch(spark, "t"))
    for name in ("words", "spell"):
        assert all((a == b).all() for a, b in zip(whole[name][1], tree[name][1], strict=True))
        assert np.allclose(whole[name][0].weights, tree[name][0].weights)


def test_large_counts_are_packed_in_proportion():
    counts = np.array([0, 0, 3, 4, 200_000, 1, 131_070, 65_535])
    assert [(int(x) & 0xFFFF, int(x) >> 16) for x in mixing_lm._packed(counts)] == [(0, 0), (3, 4), (65535, 1), (65535, 32767)]


def test_every_bit_of_a_word_is_foretold():
    words = [f"w{k}" for k in range(3000)]
    code = mixing_lm.Head(words, [5] * len(words), 400, 30).code
    paths = {tuple(code.flat[a:z].tolist()) for a, z in zip(code.offset[:-1].tolist(), code.offset[1:].tolist(), strict=True)}
    assert not code.rest.any() and len(paths) == len(words) + 2


def test_the_driver_makes_the_code_of_all_words_in_little_memory():
    import tracemalloc

    n = 1 << 16
    words, counts = [f"w{k}" for k in range(n)], (10**6 // np.arange(1, n + 1) + 1).tolist()
    tracemalloc.start()
    head = mixing_lm.Head(words, counts, 400, 30)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 32e6 and most < 2 * held
    # the code is Huffman's: with lengths as good as those of merges one by one
    import heapq

    mass, best = [*counts, 400, 30], 0
    heapq.heapify(mass)
    while len(mass) > 1:
        both = heapq.heappop(mass) + heapq.heappop(mass)
        best += both
        heapq.heappush(mass, both)
    assert int(head.code.length @ np.array([*counts, 400, 30])) == best
