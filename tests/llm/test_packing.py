"""Packing: ids against the library, gapless sequences, local search."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from listing_lifecycle_spark.llm import packing as K  # noqa: E402
from tests.llm.conftest import ODD  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def random_texts(n):
    r = random.Random(3)
    alphabet = list("aabcdeeSTRlmvd'''  \n\t\r 019é²½ÄÖß×÷ſİı 　ßЖ中文！!.,#🙂́\x1c\x85")
    return ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(n)]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_and_places(spark, texts_table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = ODD + [(100 + i, t) for i, t in enumerate(random_texts(300))] + [(900, "alpha beta, gamma " * 900)]
    got = K.packed(texts_table(rows), PATH, 64).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want.append((i or 0, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in got) // 64)
    assert least <= len(places) <= least * 1.02 + 2
    assert K.packed(texts_table([]), PATH).count() == 0


def test_many_groups_hold_every_row(spark):
    rows = [(5, 0, n) for n in [3, 7, 10, 10, 1] * 40]
    table = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint").coalesce(1)
    got = K.pack(table, 10, 16).collect()
    assert sorted(r.length for r in got) == sorted(n for *_, n in rows)
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 10


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_local_search_only_improves(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 70, 150)
    bins = [[i] for i in range(len(lengths))] if seed % 2 else K.best_fit(lengths, 100)
    before = squares(bins, lengths)
    after = K.local_search([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in after) <= 100
    assert squares(after, lengths) >= before and len(after) <= len(bins)
    assert len(after) <= -(-lengths.sum() // 100) + 2


def trades(bins, lengths, capacity):
    """All trades by which a bin takes from one that is emptier, tried one by one."""
    from itertools import combinations

    fill = [sum(lengths[i] for i in b) for b in bins]
    for b, other in ((b, o) for b in range(len(bins)) for o in range(len(bins)) if (fill[o], o) < (fill[b], b) and fill[b] < capacity):
        for out, back in ((0, 1), (1, 1), (2, 1), (1, 2)):
            for x in combinations(bins[b], out):
                for y in combinations(bins[other], back):
                    gain = sum(lengths[i] for i in y) - sum(lengths[i] for i in x)
                    if 0 < gain <= capacity - fill[b]:
                        yield b, x, other, y


@pytest.mark.parametrize("seed", range(8))
def test_no_trade_is_left(seed):
    """Where the search ends, trying every trade finds none (bins in any order of equal fill)."""
    r = np.random.default_rng(seed)
    lengths = r.integers(10, 40, 60) if seed % 2 else np.concatenate([np.full(25, 35), r.integers(5, 80, 40)])
    bins = K.local_search(K.best_fit(lengths, 100), lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    bound = -(-int(lengths.sum()) // 100)
    assert len(bins) == bound or not any(sum(lengths[i] for i in bins[o]) < sum(lengths[i] for i in bins[b]) for b, _, o, _ in trades(bins, lengths, 100))


@pytest.mark.parametrize("low,high,at_most", [(500, 900, 0.95), (380, 640, 0.95)])
def test_search_saves_sequences_where_best_fit_does_not_suffice(low, high, at_most):
    """Mixes on which best fit is far from the bound; the search saves more than a twentieth of its sequences."""
    for seed in range(3):
        lengths = np.random.default_rng(seed).integers(low, high, 1500)
        first = K.best_fit(lengths, 2048)
        after = K.local_search([list(b) for b in first], lengths, 2048)
        assert max(int(lengths[b].sum()) for b in after) <= 2048 and len(after) <= at_most * len(first)


def test_rows_may_have_any_column_names(spark):
    rows = spark.createDataFrame([(i % 3, i, 4, "g", 9, "o", i, 1) for i in range(20)], "doc_id bigint, piece int, length bigint, `group` string, sequence_id int, offset string, c0 int, g int")
    got = K.pack(rows, 10, 8)
    assert got.columns == ["doc_id", "piece", "length", "group", "c0", "g", "sequence_id", "offset"]
    assert sorted((r.doc_id, r.piece, r.length, r["group"], r.c0, r.g) for r in got.collect()) == sorted((i % 3, i, 4, "g", i, 1) for i in range(20))
    assert got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 10


def test_swaps_beat_best_fit():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # best fit first: 6+4, 5+5, 4+3+3
    apart = [[0, 5], [1, 3], [2, 4], [6]]
    assert len(K.local_search(apart, lengths, 10)) == 3
    assert len(K.best_fit(lengths, 10)) == 3
    assert K.best_fit(np.zeros(0, np.int64), 10) == [] and K.local_search([], lengths, 10) == []
