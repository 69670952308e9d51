"""Near-duplicates against all pairs of plain sets."""

import random
import re
from itertools import combinations

import pytest

from listing_lifecycle_spark.llm import neardup
from listing_lifecycle_spark.llm.components import components
from tests.llm.conftest import ODD


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def brute(rows, width, part, whole):
    sets = [plain_set(t, width) if i is not None else set() for i, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
            parent[top(a)] = top(b)
    out = []
    for k, (i, t) in enumerate(rows):
        component = i if i is None else min(rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None)
        out.append((i or 0, len(plain_set(t, width)), component or 0, i is None or i == component))
    return sorted(out)


def edited(words, random_, share):
    return [random_.choice("abcdefghij") * random_.randint(1, 5) if random_.random() < share else w for w in words]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, number = [], 0
    for group in range(25):
        base = r.choices(vocabulary, k=r.randint(3, 150))
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            rows.append((number, " ".join(edited(base, r, r.choice([0, 0, 0.01, 0.03, 0.08])))))
            number += 7
    base = r.choices(vocabulary, k=200)
    rows += [(10_000 + i, " ".join(edited(base, r, 0.02))) for i in range(150)]  # one large group
    rows += [(20_000 + i, "the same text of many copies") for i in range(60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,part,hot", [(3, 85, 20), (5, 80, 4096)])
def test_equals_all_pairs(spark, texts_table, monkeypatch, width, part, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "SMALL", 5 if hot == 20 else 500_000)
    rows = corpus(width) + [(i and i + 50_000, t) for i, t in ODD] + [(90_001, "A b"), (90_000, "a  B"), (90_002, "a b c"), (90_002, "other words here now")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(texts_table(rows), width, part, 100).collect())
    assert got == brute(rows, width, part, 100)


def test_large_group_of_similar_texts_that_are_not_linked(spark, texts_table, monkeypatch):
    """Hundreds of texts near the threshold: pairs in question are many, links few; what leaves a tile stays linear in its rows."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    r = random.Random(11)
    base = ["b%d" % i for i in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.032 else "e%d" % r.randrange(40) for w in base)) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:60] + [w if r.random() > 0.02 else "x%d" % i for w in base[60:]])) for i in range(60)]
    seen = []
    tiled = neardup.tiled
    monkeypatch.setattr(neardup, "tiled", lambda outer, every, fn, schema: seen.append((tiled(outer, every, fn, schema), every)) or seen[-1][0])
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(texts_table(rows), 3, 85, 100).collect())
    assert got == brute(rows, 3, 85, 100)
    assert len(seen) == 2 and all(made.count() <= 2 * every.count() for made, every in seen)


def test_a_region_of_equal_hashes_is_split(spark, texts_table, monkeypatch):
    """Sets that differ in a few of many shingles share all hashes of most trees: parts of at most HOT rows, bridged."""
    monkeypatch.setattr(neardup, "HOT", 16)
    base = ["b%d" % i for i in range(600)]
    rows = [(i, " ".join([*base, "tail%d" % i])) for i in range(200)] + [(900, "something else altogether here")]
    got = neardup.near_duplicates(texts_table(rows), 3, 85, 100).collect()
    assert {x.component_id for x in got if x.doc_id < 900} == {0} and len(got) == 201


def test_empty_table(spark, texts_table):
    assert neardup.near_duplicates(texts_table([])).count() == 0
    assert [r.kept for r in neardup.near_duplicates(texts_table([(1, None), (1, ""), (None, "x y z")])).collect()] == [True] * 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(900, 900), (7, 3), (3, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {7: 3, 3: 3}


def test_no_tiles_without_crowded_regions(texts_table, monkeypatch):
    """Where no region is crowded, no plan of tiles is made: its broadcasts and threads cost the driver memory."""
    monkeypatch.setattr(neardup, "tiled", None)
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(5)] + [(9, " ".join(f"w0x{j}" for j in range(30)) + " more")]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(texts_table(texts)).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 0}
