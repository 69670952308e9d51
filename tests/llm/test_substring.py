"""Substring dedup: chunks against a plain loop, planted passages, cut texts."""

import random
import zlib

import numpy as np
import pyarrow as pa

from listing_lifecycle_spark.llm import substring as S
from tests.llm.conftest import ODD

BLANKS = b" \t\n\v\f\r"


def plain_cuts(text, reach=S.REACH):
    rank = []
    for i in range(len(text)):
        h = 0
        for k in range(S.WINDOW):
            if i - 1 - k >= 0:
                h += int(S.GEAR[text[i - 1 - k]]) << k
        h = (h % 2**32) >> 2 | 1
        if text[i] not in BLANKS and (i == 0 or text[i - 1] in BLANKS):
            h |= 1 << 31
        rank.append(0 if text[i] & 0xC0 == 0x80 else h)
    near = lambda i: [rank[j] for j in range(max(0, i - reach), min(len(text), i + reach + 1)) if j != i]
    return [i for i in range(len(text)) if i == 0 or rank[i] > max(near(i), default=0)]


def sentence(r, n):
    return " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(n))


def test_cuts_equal_the_plain_rule():
    r = random.Random(1)
    for text in (sentence(r, 80), "é" * 50 + sentence(r, 9), "x" * 90, " \n ", "a", "中文" * 40 + " mixed\ttext\n\n" + "🙂" * 20):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert S.cuts(raw, np.array([0, len(raw)])).tolist() == plain_cuts(text.encode())
        both = np.concatenate([raw, raw])  # rows don't see each other
        assert S.cuts(both, np.array([0, len(raw), len(raw), 2 * len(raw)])).tolist() == [c + k for k in (0, len(raw)) for c in plain_cuts(text.encode())]


def test_an_insertion_moves_the_cuts_near_it_only():
    text = sentence(random.Random(2), 300)
    cut = lambda t: {len(t) - c for c in S.cuts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).tolist()}
    far = len(text) - 200 - S.WINDOW - S.REACH
    assert {c for c in cut(text) if c < far} == {c for c in cut(text[:200] + "INSERTED" + text[200:]) if c < far}


def test_long_stretches_are_cut_between_characters():
    raw = np.frombuffer(("é" * 9000).encode(), np.uint8)
    at = S.cuts(raw, np.array([0, len(raw)]))
    assert len(at) > 3 and not ((raw[at] & 0xC0) == 0x80).any()


def test_planted_passages(spark, texts_table):
    r = random.Random(3)
    passages = [sentence(r, 51) for _ in range(6)]
    rows, planted = [], {}
    for i in range(120):
        before, after = sentence(r, r.randint(0, 60)), sentence(r, r.randint(0, 60))
        p = i % 12
        rows.append((i, " ".join(x for x in (before, passages[p], after) if x) if p < 6 else f"{before} {after}"))
        if p < 6:
            planted.setdefault(p, []).append(i)
    found = S.repeats(texts_table(rows)).collect()
    assert {x.doc_id for x in found} == {i for ids in planted.values() for i in ids[1:]}
    text = dict(rows)
    for x in found:
        piece = text[x.doc_id].encode()[x.start : x.stop]
        assert len(piece.split()) == x.n_words >= 20 and " ".join(piece.decode().split()[3:-3]) in passages[x.doc_id % 12]
        assert x.first_doc_id == planted[x.doc_id % 12][0] and x.check == zlib.crc32(text[x.doc_id].encode()) % 2**31
    cut = {x.doc_id: x.text for x in S.cut_repeats(texts_table(rows)).collect()}
    for i, t in rows:
        spans = sorted((x.start, x.stop) for x in found if x.doc_id == i)
        left, at = b"", 0
        for a, b in spans:
            left, at = left + t.encode()[at:a], b
        assert cut[i] == (left + t.encode()[at:]).decode()


def test_odd_rows(spark, texts_table):
    r = random.Random(4)
    long = sentence(r, 60)
    rows = ODD + [(50, long), (50, long), (51, "É " + long + " 中"), (51, "other " + long), (52, long + "\n" + long), (None, long)]
    found = S.repeats(texts_table(rows)).collect()
    assert {x.doc_id for x in found} >= {51, 52} and 50 not in {x.doc_id for x in found}
    cut = S.cut_repeats(texts_table(rows))
    assert cut.columns == texts_table(rows).columns
    kept = sorted((x.doc_id or 0, x.text) for x in cut.where("text IS NOT NULL").collect())
    assert len(kept) == len(rows) - 1
    assert [t for i, t in kept if i == 50] == [long, long] and (0, long) in kept
    assert all(len(t) < 90 for i, t in kept if i in (51, 52))
    assert S.repeats(texts_table([])).count() == 0 and S.cut_repeats(texts_table([])).count() == 0


def test_repeats_within_a_row_are_marked():
    text = sentence(random.Random(5), 60)
    row, start, stop, _, digest, again = S.chunk_table(pa.array(["", text, text, text + "\n" + text]))
    assert [digest[row == r].tolist() for r in (1,)] == [digest[row == 2].tolist()] and not again[row < 3].any()
    assert again[row == 3].sum() >= (row == 1).sum() - 4 and not again[(row == 3) & (start < len(text) // 2)].any()
    assert (stop[:-1][row[1:] == row[:-1]] == start[1:][row[1:] == row[:-1]]).all()


def repeated_words(r, passage):
    """Words of the longest stretch of chunks that two texts around the passage share."""
    table = pa.array([f"{sentence(r, r.randint(5, 40))} {passage} {sentence(r, 20)}" for _ in range(2)])
    row, _, _, words, digest, _ = S.chunk_table(table)
    first, best, run = set(digest[row == 0].tolist()), 0, 0
    for d, n in zip(digest[row == 1].tolist(), words[row == 1].tolist()):
        run = run + n if d in first else 0
        best = max(best, run)
    return best


def test_passages_of_short_words_are_told_by_their_bytes():
    r = random.Random(12)
    for _ in range(100):
        assert repeated_words(r, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=160))) >= S.LEAST_WORDS
        assert repeated_words(r, sentence(r, 50)) >= S.LEAST_WORDS


def test_documents_may_have_any_column_names(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "start " + passage, "a", 5, 7), (2, passage + " end", "b", 6, 8), (3, None, "c", 7, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, span_doc_id int, `check` int")
    got = S.cut_repeats(docs)
    assert got.columns == docs.columns
    cut = {r.doc_id: tuple(r) for r in got.collect()}
    assert cut[1] == rows[0] and cut[3] == rows[2] and len(cut[2][1]) < len(rows[1][1]) and cut[2][2:] == ("b", 6, 8)
