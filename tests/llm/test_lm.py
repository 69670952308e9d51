"""LM scoring: base scores against plain counting, chances that add up, and scores against a plain walk."""

import re
from collections import Counter
from math import exp, isclose, log, log10
from time import process_time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm import lm
from tests.llm.conftest import ODD


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def plain_base(rows, trained_on):
    counts = Counter(t for i, text in rows if i is not None and trained_on(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        own = tokens(text)
        out.append((i or 0, len(own), sum(counts[t] > 0 for t in own), n, round(sum(log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), 6)))
    return sorted(out)


def test_base_scores(spark, texts_table, monkeypatch):
    monkeypatch.setattr(lm, "SHARED", 6)  # most words go through the join
    rows = ODD + [(20 + i, f"the cat {i} sat on The mat w{i % 3} end{i}") for i in range(40)]
    got = lm.score(texts_table(rows), F.col("doc_id") % 5 != 1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_base(rows, lambda i: i % 5 != 1)
    assert all(r.score < 0 for r in got)
    assert lm.score(texts_table([]), F.col("doc_id") % 5 != 1).count() == 0
    untrained = lm.score(texts_table(ODD), F.col("doc_id") < 0).collect()
    assert len(untrained) == len(ODD) and {r.n_known for r in untrained} == {0} and {r.train_tokens for r in untrained} == {0}


def test_the_most_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", max(1, 1000 // (i + 1))) for i in range(500)], "word string, times bigint")
    for bound in (0, 3, 40, 499, 500):
        got = lm.most_frequent(counts, bound)
        assert len(got) <= bound and [r.word for r in got] == [f"w{i}" for i in range(len(got))]
    assert len(lm.most_frequent(counts, 500)) == 500 and len(lm.most_frequent(counts, 40)) > 20


def test_a_band_of_ties_fills_the_list(spark):
    words = [f"w{i:04d}" for i in range(3000)]
    counts = spark.createDataFrame([("first", 900), *[(w, 7) for w in reversed(words)], *[(f"z{i}", 1) for i in range(50)]], "word string, times bigint").repartition(7, "word")
    for bound in (0, 1, 2, 1000, 3001, 3020, 3051, 4000):
        got = lm.most_frequent(counts, bound)
        assert [r.word for r in got] == ["first", *words, *sorted(f"z{i}" for i in range(50))][:bound]


def small_model():
    r = np.random.default_rng(1)
    top = [(f"w{i}", 500 // (i + 1) + 1) for i in range(400)]
    rest = 90
    total = sum(n for _, n in top) + 50 + rest
    model = lm.start(top, 50, total, len(top) + 1 + rest, rest)
    model.weights[:] = r.normal(size=model.weights.shape)
    model.slot_weights[:] = r.normal(size=model.slot_weights.shape)
    return model


def test_chances_of_a_place_add_up_to_one():
    model = small_model()
    n = len(model.words)
    for before, earlier in ((5, 9), (n, 2), (n + 1, n + 1)):
        places = lm.Stream(np.arange(n + 1), np.full(n + 1, before), np.full(n + 1, earlier), np.array([0, n + 1]))
        # The last one is the slot of all other words, which their counts and the unseen share out.
        # Slots without a word, left empty by the counts, keep a trace of the mass.
        total = (10 ** lm.log_chances(model, places)).sum()
        used = np.unique(np.append(model.slot, lm.SIDE**2 - 1))
        if len(used) == lm.SIDE**2:
            assert isclose(total, 1, abs_tol=1e-6)
        else:
            assert total <= 1 + 1e-6
    assert 0 < model.unseen() < 1


def test_streams_do_not_cross_rows():
    shared = pa.array(["", "a", "b"])
    places, *_ = lm.stream(pa.array(["a B", "", "x a"]), shared)
    assert places.word.tolist() == [1, 2, 0, 0, 3, 1, 0]
    assert places.before.tolist() == [4, 1, 2, 4, 4, 3, 1]
    assert places.earlier.tolist() == [4, 4, 1, 4, 4, 4, 3]


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    held = got.where("crc32(cast(doc_id AS string)) % 5 = 1").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert held.score > held.base + 1000
    counts_only = lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, rounds=0)
    plain = counts_only.where("crc32(cast(doc_id AS string)) % 5 = 1").agg(F.sum("score")).first()[0]
    assert held.score > plain  # the context helps


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> shift
        x = x * factor % 2**64
    return x ^ x >> 31


def plain_score(model, text, rare):
    """log10 chance of a text, token by token, with plain numbers."""
    number = {w: i for i, w in enumerate(model.words.to_pylist())}
    other, begin, single = len(number), len(number) + 1, lm.SIDE
    total, before, earlier = 0.0, begin, begin
    for word in tokens(text):
        w = number.get(word, other)
        slot = int(model.slot[w]) if w < other else single * single - 1
        group, place = divmod(slot, single)
        keys = [before << 2, (before << 32 | earlier << 2) + 1, (earlier << 2) + 2]
        keys = [plain_mix((k + 0x9E3779B97F4A7C15) % 2**64) for k in keys]
        for bias, table, at, salt in ((model.bias, model.weights, group, None), (model.slot_bias[group], model.slot_weights, place, group + 1)):
            logits = [float(b) for b in bias]
            for k in keys:
                bucket = (k if salt is None else plain_mix(k ^ salt)) >> (64 - lm.BITS)
                logits = [a + float(x) for a, x in zip(logits, table[bucket])]
            top = max(logits)
            total += (logits[at] - top) / log(10) - log10(sum(exp(x - top) for x in logits))
        if w < other:
            total += float(model.inside[w])
        else:
            c, unseen = rare.get(word, 0), model.unseen()
            total += log10((1 - unseen) * c / max(model.rare_tokens, 1)) if c else log10(unseen)
        before, earlier = w, before
    return total


def test_scores_equal_a_plain_walk(spark, texts_table, monkeypatch):
    monkeypatch.setattr(lm, "SHARED", 12)  # some words are shared, the others go through the join
    rows = ODD + [(20 + i, f"the cat {i % 9} sat on The mat w{i % 13} end{i} on the on") for i in range(60)]
    models = []
    trained = lm.trained
    monkeypatch.setattr(lm, "trained", lambda *a: models.append(trained(*a)) or models[-1])
    got = lm.score(texts_table(rows), F.col("doc_id") % 5 != 1).collect()
    (model,) = models
    assert np.abs(model.weights).max() > 0
    counts = Counter(t for i, text in rows if i is not None and i % 5 != 1 for t in tokens(text)[:-1])
    want = sorted((i or 0, round(plain_score(model, text, counts), 4)) for i, text in rows)
    assert sorted((r.doc_id or 0, round(r.score, 4)) for r in got) == want


def test_updates_are_added_up_in_a_tree(spark, tmp_path):
    """Sums of any number of tasks, no group larger than the fan."""
    r = np.random.default_rng(4)
    bodies = [(b, t, r.integers(0, 9, 4).astype(np.float32), r.integers(0, 9, 2).astype(np.float32)) for b in (0, 1024) for t in range(37) if (b, t) != (0, 5)]
    rows = [(b, a.tobytes(), a.tobytes(), m.tobytes(), m.tobytes(), t) for b, t, a, m in bodies]
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    table = spark.createDataFrame(rows, lm.UPDATE + ", task int").repartition(5).checkpoint()
    for fan in (2, 16, 64):
        got = {x.block: np.frombuffer(x.classes, np.float32) for x in lm.added_up(table, fan).collect()}
        assert {b: x.tolist() for b, x in got.items()} == {b: sum(a for c, _, a, _ in bodies if c == b).tolist() for b in (0, 1024)}
    assert lm.added_up(table.limit(0)).count() == 0


def plain_softmax(logits):
    out = np.exp(logits - logits.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def plain_chances(model, places):
    """log10 chance of each place by the formula, the largest logit of each row taken off."""
    group, place = np.divmod(np.append(model.slot, lm.SIDE**2 - 1)[places.word], lm.SIDE)
    out = np.append(model.inside, 0.0)[places.word]
    found = lm.met_by(lm.buckets(places.before, places.earlier), group)
    tables = (model.bias[None, :], model.weights, group), (model.slot_bias[group], model.slot_weights, place)
    for buckets, (bias, table, at) in zip(found, tables):
        logits = np.repeat(bias, len(group) // len(bias), axis=0)
        for f in buckets:
            logits += table[f]
        out = out + np.log10(plain_softmax(logits)[np.arange(len(group)), at])
    return out


def random_places(model, n):
    r = np.random.default_rng(5)
    number = [(r.random(n) ** 3 * (len(model.words) + 2)).astype(np.int64) for _ in range(3)]
    return lm.Stream(np.minimum(number[0], len(model.words)), *number[1:], np.array([0, n]))


def test_one_shift_serves_all_rows_unless_they_lie_far_apart():
    r = np.random.default_rng(2)
    near = r.normal(size=(50, lm.SIDE)) * 9
    for logits in (near, near + np.arange(50)[:, None] * 100, near + 5000, near * 60, near - 1e6):
        powers, total = lm.softmax(logits.copy())
        assert np.allclose(powers / total[:, None], plain_softmax(logits), rtol=1e-9, atol=0)


def test_products_of_powers_give_the_same_chances():
    model = small_model()
    places = random_places(model, 20_001)
    want = plain_chances(model, places)
    assert np.allclose(lm.log_chances(model, places), want, rtol=0, atol=1e-9)
    assert np.allclose(lm.log_chances(model, places, lm.powers(model)), want, rtol=0, atol=1e-9)
    model.weights[:] += np.arange(len(model.weights))[:, None] % 5000  # exp() of these overflows, their chances stay
    model.slot_weights[:, 3] += 100
    assert lm.powers(model) is not None
    assert np.allclose(lm.log_chances(model, places, lm.powers(model)), plain_chances(model, places), rtol=0, atol=1e-9)
    model.slot_weights[7, 3] += 100  # products might vanish: sums of logits again
    assert lm.powers(model) is None
    assert np.allclose(lm.log_chances(model, places, lm.powers(model)), plain_chances(model, places), rtol=0, atol=1e-9)


def test_updates_equal_plain_ones():
    rows = [f"W{i % 7} w{i % 31} and w{i % 11} w{i % 3} new{i}" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])
    model = small_model()
    places, *_ = lm.stream(batch.column(0), model.words)
    tables = [model.weights.copy(), model.slot_weights.copy()]
    met = [np.zeros(len(t)) for t in tables]
    for begin in range(0, len(places.word), lm.BATCH):
        own = slice(begin, begin + lm.BATCH)
        group, place = np.divmod(np.append(model.slot, lm.SIDE**2 - 1)[places.word[own]], lm.SIDE)
        found = lm.met_by(lm.buckets(places.before[own], places.earlier[own]), group)
        logits = [model.bias[None, :] + sum(tables[0][f].astype(float) for f in found[0]), model.slot_bias[group] + sum(tables[1][f].astype(float) for f in found[1])]
        for table, times, x, at, buckets in zip(tables, met, logits, (group, place), found):
            error = plain_softmax(x)
            error[np.arange(len(at)), at] -= 1
            for f in buckets:
                np.add.at(times, f, 1)
            for f in buckets:
                np.add.at(table, f, (-0.5 / np.sqrt(times[f])[:, None] * error).astype(np.float32))
    assert len(places.word) > 2 * lm.BATCH
    for u in lm._descend(iter([batch]), model, 0.5):
        own = slice(u["block"][0].as_py(), u["block"][0].as_py() + lm.BLOCK)
        for name, count, table, start, times in (("classes", "met", tables[0], model.weights, met[0]), ("slots", "slots_met", tables[1], model.slot_weights, met[1])):
            assert np.array_equal(np.frombuffer(u[count][0].as_py(), np.float32), times[own])
            change = np.frombuffer(u[name][0].as_py(), np.float32).reshape(-1, lm.SIDE)
            assert np.allclose(change, (table[own] - start[own]) * times[own, None], rtol=1e-3, atol=1e-2)


def test_scoring_takes_less_time_than_the_formula_and_looks_words_up_once(monkeypatch):
    model = small_model()
    places = random_places(model, 200_000)

    def seconds(f):
        begin = process_time()
        f()
        return process_time() - begin

    def plain():
        for begin in range(0, 200_000, lm.BATCH):
            own = slice(begin, begin + lm.BATCH)
            plain_chances(model, lm.Stream(places.word[own], places.before[own], places.earlier[own], places.offsets))

    assert min(seconds(lambda: lm.log_chances(model, places, lm.powers(model))) for _ in range(5)) < 0.7 * min(seconds(plain) for _ in range(5))
    looked = []
    index_in = lm.pc.index_in
    monkeypatch.setattr(lm.pc, "index_in", lambda *a, **b: looked.append(1) or index_in(*a, **b))
    columns = [pa.array([0, 1, 2]), pa.array(["w1 x w2 x", "", "w3"]), pa.array([7, 8, 9])]
    (got,) = lm._score(iter([pa.RecordBatch.from_arrays(columns, ["row", "text", "doc_id"])]), model)
    assert len(looked) == 1
    assert [(r["row"], r["doc_id"], r["word"], r["times"], r["n_tokens"]) for r in got.to_pylist()] == [(0, 7, "x", 2, 5), (1, 8, " 1", 0, 1), (2, 9, " 2", 0, 2)]
