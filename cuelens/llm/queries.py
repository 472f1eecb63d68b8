"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in repeated 35-word windows, whole ``documents``."""
    from cuelens.llm.substring import substring_digest

    return substring_digest(_documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword lattice likelihood of every whole text of ``documents``."""
    from cuelens.llm.lm import lm_digest

    return lm_digest(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or of sentence scores, whole ``documents``, learned from ``labels.toxic``."""
    from cuelens.llm.toxicity import toxicity_digest

    return toxicity_digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of ``documents``."""
    from cuelens.llm.langid import language_digest

    return language_digest(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of ``pages``, written, read back and reassembled."""
    from cuelens.llm.warc import warc_digest

    return warc_digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at 5-gram similarity 0.8, whole ``documents``."""
    from cuelens.llm.neardup import jaccard_digest

    return jaccard_digest(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document statistics, the base rule and the trees' verdict, whole ``documents``."""
    from cuelens.llm.quality import quality_digest

    return quality_digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``benchmark`` windows in every whole text of ``documents``."""
    from cuelens.llm.decontaminate import decontamination_digest

    return decontamination_digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text of ``documents``, and their decoding."""
    from cuelens.llm.bpe import bpe_digest

    return bpe_digest(_documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of ``documents`` written to Parquet in order of doc_id and read back."""
    from cuelens.llm.tokenfile import token_digest

    return token_digest(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all of ``embeddings``."""
    from cuelens.llm.negatives import negatives_digest

    return negatives_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document of ``documents``, drawn towards ``benchmark``."""
    from cuelens.llm.importance import importance_digest

    return importance_digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text of ``documents``, packed into windows of 1,024 tokens."""
    from cuelens.llm.packing import packing_digest

    return packing_digest(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_packing": op13_packing,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH b AS (
          SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark
        ), bw AS (
          SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
          FROM b, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS t(i) WHERE len(ws) > 0
        ), d AS (
          SELECT doc_id, {_WORDS} AS ws FROM documents
        ), dw AS (
          SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
          FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(ws) - n + 2)) AS t(i)
        ), m AS (
          SELECT doc_id, dw.i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
        ), hit AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
        ), items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), w AS (
          SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM w""",
    "op3_substring_dedup": r"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), win AS (
          SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g
          FROM w, unnest(range(1, len(ws) - 33)) AS t(i)
        ), rep AS (
          SELECT g FROM win GROUP BY g HAVING count(*) > 1
        ), gone AS (
          SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (g))
        ), kept AS (
          SELECT x.doc_id, count(gone.p) AS n_removed,
                 string_agg(CASE WHEN gone.p IS NULL THEN x.word END, ' ' ORDER BY x.p) AS kept
          FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x
          LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
          GROUP BY x.doc_id
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op8_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), g AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
          FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0
        ), n AS (
          SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), c AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), link AS (
          SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)
        ), reach AS (
          SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), class AS (
          SELECT a, min(b) AS class_id FROM reach GROUP BY a
        ), links AS (
          SELECT a, count(*) AS n_links FROM link GROUP BY a
        )
        SELECT class.a AS doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM class LEFT JOIN links USING (a)""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
    "op12_importance_resampling": f"""
        WITH tab AS (
          SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), w AS (
          SELECT 's' AS side, doc_id AS id, row_number() OVER () AS k, {_WORDS} AS ws FROM documents
          UNION ALL SELECT 't', item_id, row_number() OVER (), {_WORDS} FROM benchmark
        ), f AS (
          SELECT side, id, k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w
        ), h AS (
          SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)
        ), b AS (
          SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(len(x) // 2 AS BIGINT)), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT))),
                        lambda c, y: xor(c >> 8, t[CAST(xor(c & 255, y) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket
          FROM h, tab
        ), n AS (
          SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN b USING (f) GROUP BY bucket
        ), tot AS (
          SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM n
        ), gain AS (
          SELECT bucket, CAST(floor(1000 * ln((n.t + 1.0::DOUBLE) * (tot.s + 10000) / ((n.s + 1.0::DOUBLE) * (tot.t + 10000)))) AS BIGINT) AS g FROM n, tot
        ), m AS (
          SELECT k, count(*) AS n_features, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight
          FROM f JOIN b USING (f) JOIN gain USING (bucket) WHERE side = 's' GROUP BY k
        ), d AS (
          SELECT id AS doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', sha256('7:' || coalesce(CAST(id AS VARCHAR), ''))[i]) - 1 AS BIGINT))), lambda c, y: 16 * c + y) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
          FROM w LEFT JOIN m USING (k) WHERE side = 's'
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_words >= 20 AND row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) <= 25 * count(*) FILTER (n_words >= 20) OVER () // 100
                    THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS rank
        FROM d""",
}
