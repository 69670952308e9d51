"""Quality classifier: features against plain Python, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa

from listing_lifecycle_spark.llm import classifier as C
from listing_lifecycle_spark.llm.arrow_text import hashes, mix
from tests.llm.conftest import ODD


def plain_score(text, model):
    key = lambda w: int(hashes(pa.array([w]), seed=3)[0])
    top = lambda h: h >> 64 - C.BITS
    words, total, n = text.split(), 0.0, 0
    for w in words:
        edged = b" " + w.encode() + b" "
        buckets = [top(key(w))]
        for size in C.GRAMS:
            for i in range(len(edged) - size + 1):
                number = int.from_bytes(edged[i : i + size], "little") | size << 56
                buckets.append(top(int(mix(np.array([number], np.uint64))[0])))
        total += sum(model.margin[b] for b in buckets)
        n += len(buckets)
    for a, b in zip(words, words[1:]):
        pair = int(mix(np.array([(key(a) * 0x9E3779B97F4A7C15 + key(b)) % 2**64], np.uint64))[0]) if a != b else int(C.TWICE)
        total += model.margin[top(pair)]
        n += 1
    return 1 / (1 + np.exp(-(total / max(n, 1) + model.bias)))


def test_scores_equal_plain_features(spark, texts_table):
    model = C.Model(np.random.default_rng(0).normal(size=1 << C.BITS), 0.3)
    texts = [(1, "the cat sat on the mat mat"), (2, "é ü x"), (3, ""), (4, "a"), (5, "word " * 30 + "ÄÖ")]
    got = {r.doc_id: r.score for r in C.score(texts_table(texts), model).collect()}
    assert all(abs(got[i] - plain_score(t, model)) < 1e-9 for i, t in texts)


def test_odd_rows(spark, texts_table):
    model = C.fit(texts_table(ODD), spark.createDataFrame([(4, 1), (7, 0), (8, 5), (10, None)], "doc_id bigint, quality int"))
    rows = C.score(texts_table(ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert C.score(texts_table([]), model).count() == 0
    none = C.fit(texts_table([]), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score >= 0.5 for r in C.score(texts_table(ODD), none).collect()} == {True}
    assert C.keep(texts_table(ODD), none).columns == texts_table(ODD).columns


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    model = C.fit(docs, labels, F.col("doc_id") % 3 != 1)
    judged = C.score(docs.where("doc_id % 3 = 1"), model).join(labels, "doc_id").collect()
    right = {q: np.mean([(r.score >= 0.5) == (q == 1) for r in judged if r.quality == q]) for q in (0, 1)}
    assert right[0] > 0.95 and right[1] > 0.98


def test_vectors_count_plain_features_in_bounded_memory():
    import tracemalloc
    from collections import Counter

    r = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + c) for c in r.integers(0, 26, 9)) for _ in range(2000)]
    texts = [" ".join(vocabulary[i] for i in r.integers(0, len(vocabulary), 1000)) for _ in range(300)] + ["", None, "a a a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert batch.nbytes > 2 << 20
    tracemalloc.start()
    try:
        rows = [row for out in C._vectors(iter([batch])) for row in out.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 128 << 20  # of 3 MB of text; 256 MB and more when all n-grams were listed
    assert [row["doc_id"] for row in rows] == list(range(len(texts)))
    for i in (0, 299, 300, 301, 302):
        codes, at, word, grams, counts, pair, _ = C.features(pa.array([texts[i] or ""]))
        first = np.cumsum(counts) - counts
        times = Counter(pair.tolist())
        for code in codes:
            times.update([int(word[code]), *grams[first[code] : first[code] + counts[code]].tolist()])
        bucket, weight = np.frombuffer(rows[i]["buckets"], np.uint16), np.frombuffer(rows[i]["weights"], np.float32)
        assert bucket.tolist() == sorted(times)
        assert np.allclose(weight, [times[b] / max(sum(times.values()), 1) for b in sorted(times)])
