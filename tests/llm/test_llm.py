"""Small fixtures and brute force for the training-data operators."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import decontamination, imi, jaccard_join, line_dedup, mixing, quality, token_store, toxicity, warc
from locusflow.llm.common import Scratch, held_out, text_bytes, word_hashes
from locusflow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, path string"


def docs_of(spark, rows):
    """(doc_id, text, source) rows, with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, None, s, None, 9.0, "x") for i, t, s in rows], SCHEMA)


WORDS = [a + b for a in "ba de ki lo mu nar pel ros sut vin".split() for b in "an el or ith us ent aly om".split()]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


ODD = [(900, None, None), (901, "", "a"), (902, "word " * 3000, "a"), (903, "é ü\n\nß", None), (None, "no id here at all", "b"), (904, "same row", "a"), (904, "same row", "a")]


# -- 2: token store -----------------------------------------------------------

@pytest.mark.parametrize("values", [[], [0], [5], [1, 1, 1, 7], list(range(0, 5000, 3)), [10**12, 10**12 + 5]])
def test_elias_fano_round_trip(values):
    ef = token_store.EliasFano(token_store.ef_encode(np.array(values)))
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20000))
    assert len(token_store.ef_encode(ends)) * 8 / len(ends) < 2.5 + math.log2(ends[-1] / len(ends)) + 1


def expected_tokens(rows):
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store(spark):
    rows = [(i, prose(i, i % 40) + (" \n  x<|endoftext|>'s don't 12 " if i % 3 else ", end."), "a") for i in range(60)] + ODD
    path = Scratch(spark, "t").path("s")
    token_store.write_store(docs_of(spark, rows), path, tokenizer_path())
    store = token_store.open_store(spark, path)
    got = [tuple(r) for r in token_store.digests(store).collect()]
    assert sorted(got, key=str) == sorted(expected_tokens(rows), key=str)
    ids = {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in token_store.documents_of(store).collect()}
    assert ids == {(a, b): d for a, b, _, d in got}


def test_token_store_empty(spark):
    path = Scratch(spark, "t").path("s")
    token_store.write_store(docs_of(spark, []), path, tokenizer_path())
    assert token_store.digests(token_store.open_store(spark, path)).count() == 0


def test_piece_encoder_equals_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    parts = [" ", "  ", "\n", " \n", "a", "b", "Cd", "é", "ß", ".", ",", "!?", "'s", "'", "12", "\t", "日本", "<|endoftext|>", "’", "x\n", "\r\n", " word", " ", " "]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(4000)]
    texts += [" ".join("".join(parts[i] for i in rng.integers(4, 13, 3)) for _ in range(5)) for _ in range(2000)]
    tok, encode = Tokenizer.from_file(tokenizer_path()), token_store.PieceEncoder(tokenizer_path(), slots=64)
    got = [b for k in range(0, 6000, 200) for b in encode(pa.array(texts[k : k + 200]))]
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


# -- 3: WARC ------------------------------------------------------------------

def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\nb", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, None), (8, "u", ""), (7, "v", "é"), (3, "http://b", "<p>x</p>"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, content string, payload int")
    path = Scratch(spark, "t").path("w")
    warc.write_archive(pages, path)
    got = sorted(map(tuple, warc.read_index(spark, path).collect()), key=str)
    import base64
    import hashlib

    def digest(s):
        return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()

    first = {"<p>x</p>": 3, "": 8, "é": 7}
    want = []
    for p, _, h in rows:
        h = h or ""
        rep = p == first[h]
        want.append((p, len(h.encode()), digest(h), "response" if rep else "revisit", None if rep else first[h]))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in warc.records(spark, path).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        http, _, body = rest[:-4].partition(b"\r\n\r\n")
        assert body == (bytes(r["payload"]) if fields[b"WARC-Type"] == b"response" else b"")
        assert f"Content-Length: {len(bytes(r['payload']))}".encode() in http


def test_warc_empty(spark):
    path = Scratch(spark, "t").path("w")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_index(spark, path).count() == 0


# -- 4: decontamination -------------------------------------------------------

def brute_matches(docs, items):
    import regex

    cut = lambda t: [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]
    out = set()
    for i, t, *_ in docs:
        w = cut(t)
        for k, b in items:
            v = cut(b)
            if len(v) < decontamination.MIN_TOKENS:
                continue
            for d in range(-len(v) + 1, len(w)):
                agree = [0 <= d + p < len(w) and w[d + p] == v[p] for p in range(len(v))]
                run = max(sum(agree[p : p + 13]) for p in range(max(1, len(v) - 12)))
                if sum(agree) >= 0.8 * len(v) or len(v) >= 13 and run >= 0.8 * 13:
                    out.add((i, k))
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(4)
    items = [(k, prose(1000 + k, 14 + 5 * k)) for k in range(6)] + [(6, "too short here"), (7, None), (8, "")]
    rows = [(i, prose(i, 60), "a") for i in range(30)] + ODD
    for i in range(40):
        w = items[i % 6][1].split()
        for p in rng.choice(len(w), round(len(w) * (i % 8) * 0.04), replace=False):
            w[p] = "changed"
        if i % 5 == 4:
            w = w[:13]
        rows.append((100 + i, prose(i, 9) + ", " + " ".join(w).upper() + "! " + prose(i + 1, 9), "a"))
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, seed double")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, bench).collect()}
    assert got == brute_matches(rows, items)
    shuffled = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, bench, broadcast_seeds=0).collect()}
    assert shuffled == got
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i not in {d for d, _ in got})
    assert decontamination.matches(docs_of(spark, []), bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).count() == 0


# -- 5, 8: classifiers --------------------------------------------------------

def test_subsequence_kernel_is_the_gapped_one():
    def phi(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    if w[i].isalpha() and w[j].isalpha() and w[k].isalpha():
                        out[w[i] + w[j] + w[k]] += toxicity.LAMBDA ** (k - i + 1)
        return out

    def kernel(a, b):
        x, y = phi(a), phi(b)
        dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    for a, b in [("moron", "moron"), ("mo.ron", "moron"), ("mxoron", "moron"), ("clown", "crown"), ("banana", "ananas")]:
        x, y = toxicity.explicit(a), toxicity.explicit(b)
        assert sum(v * y.get(c, 0) for c, v in x.items()) == pytest.approx(kernel(a, b), rel=1e-5)


def labelled(spark, n, bad):
    rows = [(i, prose(i, 40) if i % 3 else bad(i), "a") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs_of(spark, rows), labels


def insulting(i):
    w = prose(i, 40).split()
    w[i % 40] = ("moronix", "cretinou", "dulbert")[i % 9 // 3]
    return " ".join(w)


def test_toxicity_learns_and_tolerates_gaps(spark):
    docs, labels = labelled(spark, 300, insulting)
    held = held_out("doc_id", 5, 0)
    model = toxicity.train(docs, labels, ~held)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0)
    extra = docs_of(spark, [(1, prose(1, 9) + " mor.onix", "a"), (2, prose(1, 9) + " c-r-e-t-i-n-o-u", "a"), (3, prose(1, 9) + " d u l b e r t " + prose(2, 5), "a"), (4, prose(7, 30), "a"), *ODD])
    marked = [(r["doc_id"], r["score"]) for r in toxicity.score(extra, model, ["doc_id"]).collect()]
    assert len(marked) == 4 + len(ODD) and all(0 <= s <= 1 for _, s in marked)
    assert all((s >= 0.5) == (i in (1, 2, 3)) for i, s in marked)
    assert toxicity.score(docs_of(spark, []), model, ["doc_id"]).count() == 0
    none = toxicity.train(docs, labels.limit(0), ~held)
    assert {r["score"] for r in toxicity.score(extra, none, ["doc_id"]).collect()} == {0.0}


def test_quality_learns(spark):
    docs, labels = labelled(spark, 300, lambda i: " ".join(w.upper() + "!!" for w in prose(i, 40).split()) if i % 2 else (prose(i, 1) + " ") * 40)
    held = held_out("doc_id", 4, 2)
    model = quality.train(docs, labels, ~held)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2)
    extra = quality.score(docs_of(spark, ODD), model, ["doc_id", "source"]).collect()
    assert len(extra) == len(ODD) and all(0 <= r["score"] <= 1 for r in extra)
    assert quality.score(docs_of(spark, []), model, ["doc_id"]).count() == 0
    none = quality.train(docs, labels.limit(0), ~held)
    assert {r["score"] for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 4)), np.where(rng.random(80) < 0.5, 1.0, -1.0)
    w, b = quality.dual_coordinate_descent([np.arange(4)] * 80, list(x), y, 4, np.full(80, 0.5), epochs=3000)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    assert all(best <= loss(w + rng.normal(size=4) * s, b + rng.normal() * s) + 2e-3 for s in (1e-3, 1e-2, 1e-1) for _ in range(50))


# -- 6: nearest neighbours ----------------------------------------------------

def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype("float32")
    x[700:1100] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    got = defaultdict(list)
    for r in imi.search(table, F.col("vec_id") % 20 == 0, chunk=128).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(v == pytest.approx(s[i], abs=1e-12) for _, i, v in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and q not in {i for _, i, _ in found}
        hits += sum(v >= np.sort(s)[-20] - 1e-9 for _, _, v in found)
    assert hits / (20 * len(got)) >= 0.9
    assert [r["vec_id"] for r in imi.search(table.where("vec_id < 3 or vec_id = 20"), F.col("vec_id") == 20).orderBy("rank").collect()].__len__() == 3
    assert imi.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_traverse_visits_pairs_in_order():
    rng = np.random.default_rng(5)
    books = [rng.normal(size=(6, 2)), rng.normal(size=(5, 2))]
    q = rng.normal(size=4)
    order = imi.traverse(q, books, {c: 1 for c in range(30)}, 30)
    scores = [books[0][c // 5] @ q[:2] + books[1][c % 5] @ q[2:] for c in order]
    assert sorted(order) == list(range(30)) and scores == sorted(scores, reverse=True)


# -- 7: Jaccard join ----------------------------------------------------------

def brute_join(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        r = root(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return Counter((i, least.get(root(k)), links[k]) for k, (i, *_) in enumerate(rows))


def near_copies(n=160):
    rng, rows, shared = np.random.default_rng(8), [], prose(77, 60)
    for i in range(n):
        w = (prose(i % 9, 120) if i % 2 else prose(i, 60) + " " + shared).split()
        for p in rng.choice(len(w), i % 5 if i % 2 else 0, replace=False):
            w[p] = f"new{i}"
        rows.append((i, " ".join(w), "a"))
    return rows + ODD


@pytest.mark.parametrize("limit,block", [(256, 512), (8, 16)])
def test_jaccard_join_against_brute_force(spark, limit, block):
    rows = near_copies()
    got = Counter(map(tuple, jaccard_join.join(docs_of(spark, rows), limit=limit, block=block).collect()))
    assert got == brute_join(rows)


def test_keep_one(spark):
    rows = near_copies(60)
    docs = docs_of(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, _ in brute_join(rows)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
    assert jaccard_join.join(docs_of(spark, [])).count() == 0


# -- 1: lines -----------------------------------------------------------------

def test_line_dedup(spark):
    base = [prose(i, 25) for i in range(12)]
    rows = [(1, "\n".join(base[:6]), "a"), (2, base[0].upper() + "!\n\n" + base[7] + "\n" + base[7], "a"), (3, base[8] + "\n" + base[1].replace(base[1].split()[3], base[1].split()[3] + "x", 1), "a"), *ODD]
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in line_dedup.digests(docs_of(spark, rows)).collect()}
    assert got[1] == (6, 6) and got[2] == (4, 2) and got[900] == (1, 1) and got[901] == (1, 1) and got[None] == (1, 1)
    text = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert text[2] == "\n" + base[7] and text[1] == "\n".join(base[:6])
    assert line_dedup.digests(docs_of(spark, [])).count() == 0


def test_edit_distance():
    rng = np.random.default_rng(11)
    for _ in range(300):
        a, b = ("".join("abcé"[i] for i in rng.integers(0, 4, rng.integers(0, 12))) for _ in range(2))
        d = np.arange(len(b) + 1)
        for i, c in enumerate(a):
            e = [i + 1]
            for j, x in enumerate(b):
                e.append(min(d[j] + (c != x), d[j + 1] + 1, e[j] + 1))
            d = e
        assert line_dedup.edit_distance(a, b) == d[-1]
        for most in range(6):
            assert (line_dedup.edit_distance(a, b, most) <= most) == (d[-1] <= most)
        assert line_dedup.edit_similar(a, b) == (d[-1] <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_forest_connects_what_similar_pairs_connect(spark):
    rng = np.random.default_rng(12)
    lines = [prose(400 + k % 6, 30) for k in range(60)]
    for k in range(60):
        w = lines[k].split()
        w[int(rng.integers(0, 30))] = f"x{k}"
        lines[k] = " ".join(w)
    sim, of, keys = line_dedup.signatures([x.encode() for x in lines])
    table = spark.createDataFrame([(k, int(sim.view(np.int64)[k]), keys[of == k].tolist(), x) for k, x in enumerate(lines)], "id long, sim long, keys array<long>, line string")
    met = line_dedup.with_candidates(line_dedup.groups(table, Scratch(spark, "t")))
    rows = met.join(met.groupBy("id").agg(F.collect_set("path").alias("leaves")), "id").join(table.select("id", "line"), "id")
    pairs = [(r["a"], r["b"]) for r in line_dedup.forest(rows).collect()]
    assert len(pairs) == len(set(pairs))
    edges = line_dedup.forest(rows).collect()
    assert all((r["a"] - r["b"]) % 6 == 0 for r in edges)
    group = list(range(60))
    for _ in range(60):
        for r in edges:
            group[r["a"]] = group[r["b"]] = min(group[r["a"]], group[r["b"]])
    assert group == [k % 6 for k in range(60)]


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in list(parent)}


# -- words --------------------------------------------------------------------

def test_word_hashes_see_words():
    import pyarrow as pa

    texts = ["one two", "", " two\tone\n", "x", "onetwo", "one"]
    h, starts, ends, first = word_hashes(*text_bytes(pa.array(texts)))
    got = [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    one, two = got[0]
    assert got == [[one, two], [], [two, one], got[3], got[4], [one]] and len({one, two, got[3][0], got[4][0]}) == 4


# -- 10: mixing ---------------------------------------------------------------

def brute_schedule(counts, weights, block):
    """Slot by slot: of the released blocks, the earliest deadline; a new phase when a source ends."""
    left, order, used = [-(-n // block) for n in counts], [], [0] * len(counts)
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        total, done, t = sum(weights[i] for i in active), [0] * len(counts), 0
        while all(left[i] for i in active):
            ready = [(-(-(done[i] + 1) * total // weights[i]), i) for i in active if done[i] * total // weights[i] <= t]
            _, i = min(ready)
            order.append((i, used[i]))
            used[i], done[i], left[i], t = used[i] + 1, done[i] + 1, left[i] - 1, t + 1
            assert all(abs(done[k] - weights[k] * t / total) < 1 for k in active)
    return order


@pytest.mark.parametrize("weights", [None, {"a": 50, "b": 30, "c": 15, None: 5}, {"a": 1}])
def test_mixing_against_brute_force(spark, weights):
    rows = [(i, prose(i, 3), ("a", "a", "b", "c", "a", None)[i % 6]) for i in range(700)] + [(5, None, "d"), (5, None, "d")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, weights, block=8, cell=50).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows)))
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    counts = [sum(s == n for *_, s in rows) for n in names]
    target = mixing.root_weights(counts) if weights is None else [weights.get(n, 1) for n in names]
    order = brute_schedule(counts, target, 8)
    assert {(names.index(r["source"]), r["block"], r["slot"]) for r in got} == {(i, b, t) for t, (i, b) in enumerate(order)}
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    assert mixing.mix(docs_of(spark, [])).count() == 0
