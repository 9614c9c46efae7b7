"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, warc
from .block_max import BlockMax
from .common import new_folder, table, written
from .line_dedup import LineDedup
from .near_dedup import NearDedup
from .packing import Packer
from .pii import PersonalData
from .pivot_search import PivotSearch
from .quality_gam import QualityClassifier
from .quality_rules import QualityRules
from .toxicity import Toxicity
from .vector_codes import VectorCodes


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    # the list of archives is written, so that they are there before they are read
    archives = written(warc.write_archives(warc.planned(table(spark, sf_dir, "pages")), folder), "archives")
    return warc.read_written(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Toxicity().fit(docs, table(spark, sf_dir, "labels")).score(docs)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDedup().components(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return QualityRules().fit(docs, table(spark, sf_dir, "labels")).score(docs).drop("probability")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PivotSearch().search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PersonalData().find(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packer(tokenizer_path("word_bpe_49k.json")).packed(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return QualityClassifier().fit(docs, table(spark, sf_dir, "labels")).score(docs)


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BlockMax().search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    codes = VectorCodes().fit(rows)
    return codes.errors(codes.coded(rows)).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return LineDedup().kept(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_toxicity, op3_near_dedup, op4_quality_rules, op5_bpe, op6_topk, op7_html_text, op8_pii, op9_packing, op10_quality_classifier, op11_block_max, op12_vector_codes, op13_line_dedup)
}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codebooks round by round: every part against every entry of its position."""
    distance = "CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    assigned = "SELECT v.vec_id, v.part, first(b.entry ORDER BY {d}, b.entry) AS entry, min({d}) AS d FROM v JOIN b{r} b ON b.part = v.part GROUP BY v.vec_id, v.part"
    steps = [
        f"i AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM i, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, x FROM v QUALIFY entry < {entries})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({assigned.format(d=distance, r=r)})",
            f"s{r} AS (SELECT part, entry, k, CAST(sum(y) AS BIGINT) AS total, count(*) AS n FROM (SELECT a.part, a.entry, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS k FROM a{r} a JOIN v USING (vec_id, part)) GROUP BY part, entry, k)",
            f"m{r} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY k) AS x FROM s{r} GROUP BY part, entry)",
            f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))",
        ]
    steps += [
        f"a{rounds} AS MATERIALIZED ({assigned.format(d=distance, r=rounds)})",
        f"c AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY i.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM c JOIN i USING (vec_id), h"


ORACLE_SQL: dict[str, str] = {
    "op11_block_max": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), s AS (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY r
), g AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM s
), p AS (
  SELECT r, term, count(*) AS tf FROM d GROUP BY r, term
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs
), q AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (
  SELECT q.i, q.item_id, s.doc_id, s.r, CAST(sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * s.n * g.n_docs) // g.n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN s ON s.r = p.r, g GROUP BY q.i, q.item_id, s.doc_id, s.r
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM c WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op12_vector_codes": _codes_sql(),
    "op1_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id IS NOT NULL THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM r""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_line_dedup": """
WITH l AS (
  SELECT doc_id, r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r""",
}
