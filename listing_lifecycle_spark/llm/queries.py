"""The operators bound to the test tables with production parameters: one query each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.bpe import round_trip

    coded = round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query(
    "op2_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), p AS (
      SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


@query("op3_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.rules import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def id_remainder(divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.classifier import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), trained_on=id_remainder(3) != 1)
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op10_minhash_near_dedup",
    r"""
    WITH RECURSIVE w AS MATERIALIZED (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM documents
    ), s AS MATERIALIZED (
      SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) END AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)
    ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    m AS MATERIALIZED (SELECT doc_id, g FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM m AS a JOIN m AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a),
    c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents AS d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, part=85, whole=100)


@query("op1_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.substring import repeats

    return repeats(table(spark, sf_dir, "documents")).drop("check")


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op9_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.licences import fit, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


@query("op8_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.lm import score

    held_out = F.coalesce(id_remainder(5) == 1, F.lit(False)).alias("held_out")
    scored = score(table(spark, sf_dir, "documents"), id_remainder(5) != 1)
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The CRC-32 of a string ``{0}``, by the table ``crc.t`` of its 256 steps.
CRC_TABLE = """crc AS MATERIALIZED (
      SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda x: CAST(x AS UBIGINT))),
          lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v FROM range(256) AS r(i))
    )"""
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, octet_length(encode({0})) + 1),
      lambda k: CAST('0x' || substr(hex(encode({0})), 2 * k - 1, 2) AS UBIGINT))), lambda c, b: xor(c >> 8, crc.t[CAST((xor(c, b) & 255) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT))"""
LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_target_resampling",
    rf"""
    WITH {CRC_TABLE},
    d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    f AS MATERIALIZED (SELECT k, unnest(w) AS w FROM d),
    b AS MATERIALIZED (SELECT unnest(regexp_extract_all({LOWERED.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    u AS MATERIALIZED (SELECT w, {CRC.format("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM b), crc),
    s AS (SELECT bucket, count(*) AS n FROM f JOIN u USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM b JOIN u USING (w) GROUP BY bucket),
    g AS MATERIALIZED (
      SELECT x.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT bucket FROM u) AS x LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
    ),
    m AS (SELECT k, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN u USING (w) JOIN g USING (bucket) GROUP BY k),
    z AS (
      SELECT d.k, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (k)
    ),
    r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20 AND doc_id IS NOT NULL)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (k)
    """,
)
def target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, longest=1, buckets=10000, seed=2024)


#: Host, path and verdict of the rules that ``op12_url_filters`` applies.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(
    "op12_url_filters",
    rf"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS k FROM pages),
    p AS MATERIALIZED (SELECT k, page_id, {LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
    h AS (
      SELECT k, max(struct_pack(n := len(r.host) + len(r.path), rule := r.host || r.path, verdict := r.verdict)) AS best
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k
    )
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN h USING (k)
    """,
)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


@query(
    "op13_spelling_variants",
    rf"""
    WITH {CRC_TABLE},
    o AS MATERIALIZED (
      SELECT doc_id, w, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all({LOWERED.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents WHERE text IS NOT NULL
      ) GROUP BY ALL
    ),
    h AS (SELECT w, n, {CRC.format("x")} AS h FROM (SELECT w, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS x FROM o), crc),
    c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % len(w) AS BIGINT)) || substr(w, CAST(h % len(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h),
    v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    k AS MATERIALIZED (SELECT word, len(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM v)),
    e AS (
      SELECT DISTINCT a.word AS a, b.word AS b FROM k AS a JOIN k AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT k.word, v.word FROM k JOIN v ON k.rest = v.word UNION SELECT v.word, k.word FROM k JOIN v ON k.rest = v.word
    ),
    p AS MATERIALIZED (
      SELECT e.a AS word, count(*) AS n_near, arg_min(e.b, struct_pack(f := -y.n, w := encode(e.b))) AS best, max(y.n) AS best_n
      FROM e JOIN v AS y ON y.word = e.b GROUP BY e.a
    ),
    f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN p USING (word)),
    r AS (
      WITH RECURSIVE s AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT s.word, f.form, d + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
      SELECT word, arg_max(root, d) AS root FROM s GROUP BY word
    )
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
    """,
)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listing_lifecycle_spark.llm.variants import spelling_variants as grouped

    return grouped(table(spark, sf_dir, "documents"))
