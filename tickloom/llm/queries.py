"""The queries of the llm operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .sql import licence_sql, quality_sql


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    judged = judge(table(spark, sf_dir, "documents"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*names, F.round("posterior", 6).alias("posterior"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import read_tokens, write_tokens

    path = write_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lengths import length_histogram

    return length_histogram(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs.where(~held_out).select("text", "lang"))
    return predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminate

    found = contaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["end"] - h["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    dealt = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=40)
    return dealt.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wfst import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("piece_bpe_32k.model")).drop("text")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT b, root FROM reach JOIN two ON a = node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id, r.root = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT row_no, i, n, item FROM dwin JOIN win USING (n, s)),
words AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM hit) GROUP BY row_no),
items AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT row_no, item FROM hit) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_licences": op8_licences,
    "op9_shards": op9_shards,
    "op10_sentencepiece": op10_sentencepiece,
}
SQL = {"op1_quality_rules": quality_sql(), "op8_licences": licence_sql(), "op3_near_duplicates": OP3_SQL, "op7_decontaminate": OP7_SQL}
