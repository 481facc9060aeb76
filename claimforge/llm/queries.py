"""The queries of this subpackage: one thin ``opN_<name>`` per operator, over its whole table, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as op11
from . import divergence as op12
from . import embedding_dedup as op5
from . import exact_dedup as op1
from . import language as op8
from . import licences as op9
from . import line_dedup as op3
from . import manifest as op13
from . import mixing as op7
from . import ngram_join as op10
from . import packing as op2
from . import pii as op6
from . import toxicity as op4


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.pack(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op8.identify(docs, op8.profiles(docs))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.fuzzy_lines(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op4.score(docs, op4.learn(docs, _table(spark, sf_dir, "labels")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_recall_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that op5_embedding_dedup finds for the rows with an id divisible by 50, against all rows of their label."""
    return op5.audit(_table(spark, sf_dir, "embeddings"), op5_embedding_dedup(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.detect(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.mix(_table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.scan(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.ngram_join(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.digests(op11.decode(op11.encode(_table(spark, sf_dir, "documents"))))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.audit(_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other copy has the text in lower case where 3 divides the checksum of the id."""
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER))
    return op13.manifest(_table(spark, sf_dir, "documents"), lowered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_packing": op2_packing,
        "op3_line_dedup": op3_line_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op5_recall_audit": op5_recall_audit,
        "op6_pii": op6_pii,
        "op7_mixing": op7_mixing,
        "op8_language": op8_language,
        "op9_licences": op9_licences,
        "op10_ngram_join": op10_ngram_join,
        "op11_bpe": op11_bpe,
        "op12_divergence": op12_divergence,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
        """,
        "op12_divergence": rf"""
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
            w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
            g AS (SELECT DISTINCT lang, source FROM d),
            c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
            e AS (SELECT lang, g.source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
            l AS (SELECT lang, term, sum(n) AS n FROM e GROUP BY 1, 2),
            p AS (SELECT *, CAST(1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER x + count(*) OVER x) AS HUGEINT) AS p FROM e WINDOW x AS (PARTITION BY lang, source)),
            q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER x + count(*) OVER x) AS HUGEINT) AS q FROM l WINDOW x AS (PARTITION BY lang)),
            s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
            o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
            z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
            SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 200
        """,
        "op10_ngram_join": rf"""
            WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2], ' ', w[i + 3])) END) AS g FROM d),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * met >= 85 * (a.n + b.n - met)),
            e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
            r AS (SELECT doc_id, doc_id AS found FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.found)
            SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(found) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
        """,
    }
