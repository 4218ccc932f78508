"""The registered queries op1 to op13: each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op01_jaccard import jaccard_components
from .op02_suffix import drop_repeated_bytes
from .op03_bpe import bpe_digests
from .op04_topk import top_k
from .op05_toxicity import learn_toxicity, score_toxicity
from .op06_token_file import token_file_digests
from .op07_packing import pack_tokens
from .op08_language import identify_language, learn_languages
from .op09_passages import drop_repeated_passages
from .op10_tiff import media_digests
from .op11_decontaminate import leak_digests
from .op12_resampling import importance_resample
from .op13_whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(table(spark, sf_dir, "documents"), length=200, digest=True)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn_toxicity(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, learn_languages(docs, fold_of("doc_id", 3) != 1))
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents"), window=50, digest=True)


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10_000, seed=2024)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard, op2_suffix_array, op3_byte_bpe, op4_exact_top_k, op5_toxicity, op6_token_files, op7_packing, op8_language, op9_passages, op10_tiff, op11_decontamination, op12_resampling, op13_whitening]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
                       FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
                 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op11_decontamination": rf"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS w FROM documents),
                 i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n
                       FROM (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
                 k AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM i, unnest(range(1, len(w) - n + 2)) t(s)),
                 l AS (SELECT DISTINCT n FROM k),
                 p AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM d, l, unnest(range(1, len(w) - n + 2)) t(s)),
                 o AS (SELECT * FROM p WHERE k IN (SELECT k FROM k)),
                 h AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS word FROM o) GROUP BY r),
                 f AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o JOIN k USING (n, k) GROUP BY r)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)""",
        "op12_resampling": rf"""
            WITH c AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS c FROM range(256) t(b)),
                 d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS w FROM documents),
                 dw AS (SELECT r, unnest(w) AS word FROM d),
                 bw AS (SELECT unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}')) AS word FROM benchmark),
                 v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
                 y AS (SELECT word, list_transform(range(1, len(x), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT)) AS bytes FROM v),
                 z AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, c[xor(a, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM y, c),
                 s AS (SELECT bucket, count(*) AS s FROM dw JOIN z USING (word) GROUP BY bucket),
                 t AS (SELECT bucket, count(*) AS t FROM bw JOIN z USING (word) GROUP BY bucket),
                 g AS (SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) + 10000)))) AS BIGINT) AS gain
                       FROM range(10000) q(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
                 m AS (SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN z USING (word) JOIN g USING (bucket) GROUP BY r),
                 e AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, substr(sha256(concat('2024:', doc_id)), 1, 8) AS x FROM d LEFT JOIN m USING (r)),
                 n AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', x[i]) - 1 AS BIGINT))), lambda a, b: 16 * a + b) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
                 k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM n WHERE n_features >= 20)
            SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM k) THEN rank END AS rank FROM n LEFT JOIN k USING (r)""",
    }
