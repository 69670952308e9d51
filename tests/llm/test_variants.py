"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from listing_lifecycle_spark.llm import variants
from listing_lifecycle_spark.llm.runs import crc32_of, joined_crc32
from tests.llm.conftest import ODD


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_letters, least_count, every):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_letters and c >= least_count}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def edited(word, r):
    place, letter = r.randrange(len(word)), r.choice("abcdé")
    return r.choice([word[:place] + letter + word[place + 1 :], word[:place] + word[place + 1 :], word[:place] + letter + word[place:]])


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdé×", k=r.randint(4, 9))) for _ in range(60)]
    for _ in range(3):
        words += [edited(w, r) for w in words if len(w) > 1]
    words += ["x" * 300, "x" * 299 + "y", "x" * 301, "abcde", "edcba", "abced"]  # long words, same letters in another order
    texts = [" ".join(w if r.random() < 0.8 else w.upper() for w in r.choices(words, weights=[1 / (i % 60 + 1) for i in range(len(words))], k=r.randint(0, 300))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + ODD + [(5000, "abcde " * 40 + "abcdf-abcdf,abcdf " + "x" * 300 + "9")] * 3


@pytest.mark.parametrize("groups,owners,visitors,every", [(5, 2048, 8192, 97), (2, 8, 11, 7), (1, 1000, 16, 0)])
def test_equals_all_pairs(spark, texts_table, monkeypatch, groups, owners, visitors, every):
    monkeypatch.setattr(variants, "STRIP", 50 if groups == 1 else 256)
    monkeypatch.setattr(variants.near_words, "__defaults__", (groups, owners, visitors))
    rows = corpus(groups)
    got = variants.spelling_variants(texts_table(rows), 5, 3, 2, every, groups).collect()
    want = brute(rows, 5, 3, every)
    assert len(got) == len(want) > 200
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want
    assert any(x.root not in (x.word, x.form) for x in got)


def test_hot_word_and_empty_tables(spark, texts_table):
    assert variants.spelling_variants(texts_table([])).collect() == []
    assert variants.spelling_variants(texts_table([(1, None), (2, "12 . ")])).collect() == []
    got = variants.spelling_variants(texts_table([(1, "colour " * 9000 + "color " * 5 + "colur " * 3)]), every=0).collect()
    assert sorted((x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in got) == [
        ("color", "colour", "colour", 5, 2, 9000), ("colour", None, "colour", 9000, 2, None), ("colur", "colour", "colour", 3, 2, 9000),
    ]
    with pytest.raises(ValueError):
        variants.spelling_variants(texts_table([]), ratio=1)


def test_joined_crc32():
    r = random.Random(2)
    first, then = ["%d:" % r.randrange(10**9) for _ in range(300)], ["é" * r.randrange(200) + "q" * r.randrange(9) for _ in range(300)]
    got = joined_crc32(crc32_of(pa.array(first)), crc32_of(pa.array(then)), np.array([len(x.encode()) for x in then]))
    assert got.tolist() == [zlib.crc32((a + b).encode()) for a, b in zip(first, then)]
