"""Quality rules against plain counting, and the forest against the labels."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from listing_lifecycle_spark.llm import rules
from listing_lifecycle_spark.llm.arrow_text import words
from tests.llm.conftest import ODD

LABELS = "doc_id bigint, quality int, toxic int, text string"


def plain(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {j for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


TEXTS = [*ODD, (30, "a b c d e a b c d e"), (31, "x\nx\n \n \nx y\nx"), (32, "a a a a a a"), (33, "one two # three | four <b> & five six seven eight nine ten é"), (34, "\x0b\x0ca\rb\n" * 9), (35, "p q r s t u\np q r s t u v w x y z 1 2 3 4 5 6 7 8 9 10 11 12")]


def test_base_counts_equal_plain_counting(spark, texts_table):
    forest = rules.Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1, 2), np.int64), np.zeros((1, 1)), 2, 2.0)
    rows = rules.judge(texts_table(TEXTS), forest).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((i or 0, *plain(t)) for i, t in TEXTS)
    assert all(r.kept is (not r.base_failed) for r in rows)
    assert rules.judge(texts_table([]), forest).count() == 0


def test_repeated_windows_do_not_cross_rows():
    codes, _, at = words(pa.array(["a b c d e", "a b c d e", "a b c d e x a b c d e"]))
    assert rules.repeated(codes, at, 5).tolist() == [False] * 10 + [True] * 5 + [False] + [True] * 5


def test_forest_scores_equal_walking_each_tree():
    random = np.random.default_rng(2)
    x = random.normal(size=(300, 4))
    x[:6] += 9
    forest = rules.Forest(*rules.grow(x, 20, 64, 1), 64, 0.5)
    total = np.zeros(len(x))
    for t in range(20):
        for i, row in enumerate(x):
            node = 0
            while forest.feature[t, node] >= 0:
                node = forest.below[t, node, int(row[forest.feature[t, node]] > forest.split[t, node])]
            total[i] += forest.path[t, node]
    assert np.allclose(forest.scores(x), 2 ** (-total / 20 / rules.average_path(64)))
    assert forest.scores(x)[:6].min() > np.quantile(forest.scores(x), 0.9)
    good = np.arange(300) >= 6
    assert (forest.scores(x)[:6] > rules.calibrated(forest.scores(x), good, 0.9)).all()
    assert rules.calibrated(np.ones(3), np.ones(3, bool), 0.9) == 0.6


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    forest = rules.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = rules.judge(docs.where("doc_id % 2 = 1"), forest).join(labels.select("doc_id", "quality"), "doc_id").select("kept", "base_failed", "quality").collect()
    good = [r.kept for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in judged if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05
    kept = rules.keep(docs.limit(300), forest)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rules.judge(docs.limit(300), forest).where("kept").collect())


@pytest.mark.parametrize("rows", [[], [(4, 1, 0, "")], [(None, 1, 0, ""), (4, None, 0, ""), (8, 0, 0, ""), (8, 1, 0, "")]])
def test_few_labels(spark, texts_table, rows):
    forest = rules.fit(texts_table(TEXTS), spark.createDataFrame(rows, LABELS))
    assert rules.judge(texts_table(TEXTS), forest).count() == len(TEXTS)


def test_all_labelled_documents_count(spark, texts_table):
    """None is left out of the leaves or the threshold, however many there are: here more than the 6000 of old."""
    texts = [(i, " ".join(f"{chr(97 + j)}{i * 7 % (j + 5)}" for j in range(12 + i % 5))) for i in range(6500)]
    bad = [(i, " ".join(f"%{j}&{i}" for j in range(12))) for i in range(6500, 7000)]
    labels = spark.createDataFrame([(i, int(i < 6500), 0, "") for i in range(7000)], LABELS)
    forest = rules.fit(texts_table(texts + bad), labels, trees=20)
    assert forest.rows == 7000
    x = rules.statistics(pa.array([t for _, t in texts + bad]))[1]
    levels, good = forest.levels(), np.arange(7000) < 6500
    for t, node in enumerate(forest.leaves(x)):
        assert np.allclose(forest.path[t, node], levels[t, node] + rules.average_path(np.bincount(node))[node])
    scores = forest.scores(x)
    best = max((scores[good] <= c).mean() + (scores[~good] > c).mean() for c in scores if (scores[good] <= c).mean() >= 0.99)
    assert abs((scores[good] <= forest.threshold).mean() + (scores[~good] > forest.threshold).mean() - best) < 0.002
    again = rules.fit(texts_table((texts + bad)[::-1]).repartition(3), labels.repartition(2), trees=20)
    assert (again.split == forest.split).all() and (again.path == forest.path).all() and again.threshold == forest.threshold
