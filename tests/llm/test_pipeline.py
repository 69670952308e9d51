"""The pipeline on a table with planted rows, stage by stage against plain versions."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from listing_lifecycle_spark.llm import classifier, rules  # noqa: E402
from listing_lifecycle_spark.llm.arrow_text import stored  # noqa: E402
from tests.llm.conftest import ODD  # noqa: E402
from tests.llm.test_neardup import brute  # noqa: E402
from tests.llm.test_rules import plain  # noqa: E402

SOURCE = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents of the smallest table with odd rows, near copies and a shared passage added."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SOURCE}/documents.parquet").where("doc_id < 400").collect()]
    r = random.Random(1)
    good = {x.doc_id for x in spark.read.parquet(f"{SOURCE}/labels.parquet").where("quality = 1 AND doc_id < 400").collect()}
    base = [d for d in docs if d[0] in good and 60 < len(d[1].split()) < 300]
    passage = " ".join(base[0][1].split()[:55])
    for k, d in enumerate(base[1:12]):
        words = d[1].split(" ")
        words[r.randrange(len(words))] = "changed"
        text = " ".join(words)
        docs.append((50_000 + k, text, d[2], d[3], len(text)))
        text = f"{' '.join(base[20 + k][1].split()[::-1])} {passage} {' '.join(base[34 + k][1].split()[::-1])}"
        docs.append((60_000 + k, text, d[2], d[3], len(text)))
    docs += [(i and i + 90_000, t, "en", None, None) for i, t in ODD] + [docs[3]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SOURCE}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "substring_dedup", "best_fit_packing"]
    steps = dict(corpus_pipeline.STAGES)
    forest = rules.fit(docs, labels)
    first = stored(steps["quality_rules"](spark, docs, folder), "t")
    assert first.dtypes == docs.dtypes
    score = [r.score for r in rules.judge(docs, forest).select("score").collect()]
    assert len(score) == docs.count()
    import pyarrow as pa

    want = []
    for i, t in rows_of(docs):
        _, features = rules.statistics(pa.array([t or ""]))
        if not plain(t)[-1] and forest.scores(features)[0] <= forest.threshold:
            want.append((i or 0, t))
    assert sorted((i or 0, t) for i, t in rows_of(first)) == sorted(want)

    second = stored(steps["quality_classifier"](spark, first, folder), "t")
    model = classifier.fit(docs, labels)
    assert sorted((i or 0, t) for i, t in rows_of(second)) == sorted((i or 0, t) for i, t in rows_of(first) if model.scores(pa.array([t]))[0] >= 0.5)
    assert second.count() > 0.9 * first.count()

    third = stored(steps["near_dedup"](spark, second, folder), "t")
    before = rows_of(second)
    kept = {i for i, _, c, k in brute(before, 5, 80, 100) if k}
    assert sorted(i or 0 for i, _ in rows_of(third)) == sorted(kept)
    assert third.dtypes == docs.dtypes and {i for i, _ in rows_of(third)}.isdisjoint(range(50_000, 50_011))

    fourth = stored(steps["substring_dedup"](spark, third, folder), "t")
    assert fourth.count() == third.count() and fourth.dtypes == docs.dtypes
    old, new = dict(rows_of(third)), dict(rows_of(fourth))
    planted = [i for i in new if i and 60_000 <= i < 60_011]
    assert len(planted) >= 8 and all(20 <= len(old[i].split()) - len(new[i].split()) <= 57 for i in planted)
    assert sum(old[i] == new[i] for i in new) > 0.7 * len(new)
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    last = steps["best_fit_packing"](spark, fourth, folder).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t in rows_of(fourth):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want += [(i or 0, k // 2048, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id or 0, r.piece, r.length, r.ids_crc32) for r in last) == sorted(want)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or 0, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id or 0, r.piece, r.ids_crc32) for r in last)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
