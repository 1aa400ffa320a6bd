"""Texts on which a polynomial hash modulo 2**64 collides, for each operator that hashes bytes."""

import numpy as np
import pyarrow as pa

from locusflow.llm import jaccard_join, quality, token_store
from locusflow.llm.common import ByteTable, range_hashes, text_bytes, word_hashes
from locusflow.llm.queries import tokenizer_path
from tests.llm.test_llm import docs_of, prose

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(SWAP)
    return w


ONE = thue_morse(1024)
TWO = ONE.translate(SWAP)
#: Shorter than what is hashed in one call.
SHORT = thue_morse(128), thue_morse(128).translate(SWAP)


def test_words_differ():
    for a, b in ((ONE, TWO), SHORT):
        h = word_hashes(*text_bytes(pa.array([a, b, a])))[0]
        assert h[0] != h[1] and h[0] == h[2]


def test_byte_table_is_exact_under_equal_hashes():
    words = [prose(i, 1 + i % 5).replace(" ", "") + str(i) for i in range(300)]
    raw = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    starts, data, same = ends - [len(w) for w in words], np.frombuffer(raw, np.uint8), np.zeros(300, np.uint64)
    table = ByteTable(1024)
    table.add(data, starts[:200], ends[:200], same[:200])
    assert table.find(data, starts, ends, same).tolist() == [*range(200), *[-1] * 100]
    tags = np.ones(300, bool)
    assert (table.find(data, starts, ends, same, tags) == -1).all()
    table.add(data, starts[200:], ends[200:], same[200:], tags[200:])
    assert table.find(data, starts, ends, same, tags).tolist() == [*[-1] * 200, *range(200, 300)]


def test_ranges_of_one_length_up_to_eight_never_collide():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 80_000).astype(np.uint8)
    starts = np.arange(0, 80_000, 8)
    h = range_hashes(data, starts, starts + 8)
    assert len(np.unique(h)) == len({data[s : s + 8].tobytes() for s in starts.tolist()})


def test_token_ids(spark):
    texts = [f"x {w} y" for w in (ONE, TWO, *SHORT)]
    encode = token_store.PieceEncoder(tokenizer_path())
    assert encode(pa.array(texts)) == [i.tobytes() for i in encode.whole(texts)]


def test_join_has_no_false_link(spark):
    rows = [(i, f"one two {w} three four", "a") for i, w in enumerate((ONE, TWO, *SHORT))]
    assert sorted(map(tuple, jaccard_join.join(docs_of(spark, rows)).collect())) == [(i, i, 0) for i in range(4)]


def test_quality_features_differ():
    one, two = quality.indicators(*text_bytes(pa.array([f"x {ONE} y", f"x {TWO} y"])))
    assert set(one.tolist()) != set(two.tolist())
