"""The query catalogue: operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import embedders, evaluation, evidence, judges, legal, percolate, ranks, records, scoring, search, state
from ..render import markdown, pages
from ..sources import readers
from ..streaming import legal_fold, monitor
from . import oracle_text as O
from .views import BRIEF, QUERY, SPEC, cte, spec, view

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_records")
    return rows.withColumn("claims", F.when(F.col("claim").isNull(), F.array().cast("array<string>")).otherwise(F.array("claim")))


def _fused(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    return judges.judge_fused(scoring.claim_elements(_records(spark, sf_dir)), spec(spark), **more)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_records(spark, sf_dir), spec(spark))


JUDGED = cte("v_records") + ", " + O.judged(SPEC)
r4 = lambda c: F.round(c, 4).alias(c)

# ---- numbers ----

_K = r"'^(.*[0-9][\s\-]*?)[\s\-]*([A-Z][0-9]?)\s*$'"
_NUM = cte("v_numbers") + f""", a AS (SELECT p_partkey, raw, trim(raw) AS s, upper(trim(raw)) AS up FROM v_numbers),
    b AS (SELECT *, CASE WHEN s = '' THEN 'E' WHEN starts_with(s, '特') THEN 'JP' WHEN starts_with(up, 'US') THEN 'US' WHEN starts_with(up, 'EP') THEN 'EP'
            WHEN starts_with(up, 'WO') THEN 'WO' ELSE 'X' END AS o, nullif(regexp_extract(up, {_K}, 2), '') AS k0,
            CASE WHEN regexp_extract(up, {_K}, 1) = '' THEN up ELSE regexp_extract(up, {_K}, 1) END AS head FROM a),
    c AS (SELECT *, CASE WHEN o = 'JP' THEN CASE WHEN s LIKE '特開平%' THEN concat('1998', lpad(regexp_extract(s, '-([0-9]+)', 1), greatest(6, length(regexp_extract(s, '-([0-9]+)', 1)))::INTEGER, '0'))
            ELSE regexp_replace(s, '[^0-9]', '', 'g') END ELSE regexp_replace(head, '[^0-9]', '', 'g') END AS number FROM b),
    d AS (SELECT *, CASE WHEN o = 'JP' THEN CASE WHEN s LIKE '特許%' THEN 'B' ELSE 'A' END WHEN o IN ('WO') THEN coalesce(k0, 'A1') WHEN o = 'US' AND length(number) = 11 THEN coalesce(k0, 'A1') WHEN o IN ('US', 'EP') THEN k0 END AS kind FROM c),
    n AS (SELECT p_partkey, CASE o WHEN 'E' THEN 'UNKNOWN' WHEN 'X' THEN 'UNKNOWN' ELSE o END AS office, number, kind,
            CASE WHEN o IN ('E', 'X') THEN number ELSE concat_ws('-', o, number, kind) END AS canonical,
            CASE WHEN o IN ('E', 'X') THEN 'unknown' WHEN o = 'JP' THEN CASE WHEN s LIKE '特許%' THEN 'grant' ELSE 'publication' END WHEN o = 'WO' THEN 'publication'
              WHEN o = 'EP' THEN CASE WHEN kind LIKE 'B%' THEN 'grant' WHEN kind LIKE 'A%' THEN 'publication' ELSE 'unknown' END
              WHEN length(number) = 11 THEN 'publication' WHEN length(number) BETWEEN 6 AND 8 THEN 'grant' ELSE 'unknown' END AS doc_type,
            CASE o WHEN 'E' THEN 0.0 WHEN 'X' THEN 0.4 WHEN 'JP' THEN CASE WHEN s LIKE '特開2%' THEN 0.85 ELSE 0.7 END WHEN 'WO' THEN 0.88
              WHEN 'EP' THEN CASE WHEN length(number) = 7 AND kind IS NOT NULL THEN 0.92 ELSE 0.8 END
              ELSE CASE WHEN length(number) = 11 THEN 0.9 WHEN length(number) BETWEEN 6 AND 8 THEN CASE WHEN kind IS NULL THEN 0.85 ELSE 0.95 END ELSE 0.5 END END::DOUBLE AS confidence FROM d)"""


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalise(view(spark, sf_dir, "v_numbers"))


@query(_NUM + " SELECT *, (confidence < 0.85 OR office = 'UNKNOWN') AS needs_review FROM n")
def normalize_numbers(spark, sf_dir):
    return _numbers(spark, sf_dir).select("p_partkey", "office", "number", "kind", "canonical", "doc_type", "confidence", "needs_review")


@query(_NUM + " SELECT canonical, canonical AS again, true AS same FROM n WHERE office IN ('US', 'EP', 'WO')")
def normalize_roundtrip(spark, sf_dir):
    first = _numbers(spark, sf_dir).filter(F.col("office").isin("US", "EP", "WO")).select(F.col("canonical").alias("raw"))
    again = N.normalise(first)
    return again.select(F.col("raw").alias("canonical"), F.col("canonical").alias("again"), (F.col("raw") == F.col("canonical")).alias("same"))


@query(_NUM + " SELECT office, count(*) AS n FROM n WHERE confidence < 0.85 OR office = 'UNKNOWN' GROUP BY 1")
def numbers_review_queue(spark, sf_dir):
    return _numbers(spark, sf_dir).filter("needs_review").groupBy("office").agg(F.count(F.lit(1)).alias("n"))


# ---- look-ups ----

_ASKED = ", asked AS (SELECT concat('US-', CAST(8000000 + 2 * p_partkey AS STRING), '-B2') AS canonical, 'US' AS office, CAST(8000000 + p_partkey AS STRING) AS number FROM v_records)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    canonical = F.concat(F.lit("US-"), (8000000 + 2 * key).cast("string"), F.lit("-B2"))
    return view(spark, sf_dir, "v_records").select(canonical.alias("canonical"), F.lit("US").alias("office"), (8000000 + key).cast("string").alias("number"))


@query(cte("v_records") + _ASKED + " SELECT canonical, false AS found FROM asked WHERE canonical NOT IN (SELECT canonical FROM v_records) UNION ALL SELECT canonical, true FROM asked SEMI JOIN v_records USING (canonical)")
def fetch_left_not_found(spark, sf_dir):
    found, missed = records.fetch(_asked(spark, sf_dir).select("canonical"), view(spark, sf_dir, "v_records").select("canonical", "title"))
    return found.select("canonical", F.lit(True).alias("found")).unionByName(missed.select("canonical", F.lit(False).alias("found")))


@query(cte("v_records") + _ASKED + """ SELECT a.canonical AS asked, coalesce(r.title, s.title) AS title FROM asked a LEFT JOIN v_records r USING (canonical)
    LEFT JOIN v_records s ON r.canonical IS NULL AND s.office = a.office AND s.number = a.number WHERE r.canonical IS NOT NULL OR s.canonical IS NOT NULL""")
def fixture_two_key(spark, sf_dir):
    return records.two_key(_asked(spark, sf_dir), view(spark, sf_dir, "v_records")).select("asked", "title")


@query(cte("v_records") + _ASKED + " SELECT canonical, title, claim FROM v_records WHERE canonical IN (SELECT canonical FROM asked)")
def fetch_semi(spark, sf_dir):
    return view(spark, sf_dir, "v_records").join(_asked(spark, sf_dir).select("canonical"), "canonical", "left_semi").select("canonical", "title", "claim")


_CHAIN = cte("v_records") + _ASKED + """, x AS (SELECT DISTINCT canonical FROM asked), k AS (SELECT canonical, p_partkey FROM v_records),
    h AS (SELECT x.canonical, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 5 < 3 THEN 1 WHEN p_partkey IS NOT NULL THEN 2 ELSE 3 END AS hop FROM x LEFT JOIN k USING (canonical))"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "v_records").select("canonical", "p_partkey")
    return records.fallback(_asked(spark, sf_dir), [("fixture", rows.filter("p_partkey % 3 = 0")), ("export", rows.filter("p_partkey % 5 < 3")), ("bulk", rows)])


@query(_CHAIN + " SELECT canonical, ['fixture', 'export', 'bulk'][hop + 1] AS source FROM h WHERE hop < 3")
def fallback_chain(spark, sf_dir):
    return _chain(spark, sf_dir)[0].select("canonical", "source")


@query(_CHAIN + """ SELECT canonical, CAST(seq AS INTEGER) AS seq, ['fixture', 'export', 'bulk'][seq + 1] AS source, CASE WHEN seq = hop THEN 'hit' ELSE 'miss' END AS outcome
    FROM h, range(3) r(seq) WHERE seq <= hop""")
def fallback_trail(spark, sf_dir):
    return _chain(spark, sf_dir)[1]


# ---- publications and claims ----


def _publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    said = F.coalesce("text", F.lit(""))
    pair = lambda text, lang: F.struct(text.alias("text"), lang.alias("language"))
    first = F.coalesce(F.get(T.sentences(said), F.lit(0)), F.lit(""))
    code = F.struct(F.concat(F.upper("source"), F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("code"))
    day = (20000101 + F.col("doc_id") % 28 + 10000 * (F.col("doc_id") % 9)).cast("bigint")
    return docs.select(
        F.concat(F.upper("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("-A1")).alias("publication_number"),
        F.upper("lang").alias("country_code"),
        F.when(F.col("doc_id") % 10 == 0, None).otherwise(day).alias("publication_date"),
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.floor(F.col("doc_id") / 4).cast("string")).alias("family_id"),
        F.array(pair(F.lit("titre"), F.lit("fr")), pair(first, F.lit("EN"))).alias("title_localized"),
        F.array(pair(said, F.col("lang"))).alias("abstract_localized"),
        F.array(pair(F.concat(F.lit("1. A first claim.\n2. The claim of 1, "), F.col("source")), F.lit("en"))).alias("claims_localized"),
        F.array(code).alias("cpc"),
        F.array(F.struct(F.col("source").alias("name"), F.lit("XX").alias("country_code"))).alias("assignee_harmonized"),
    )


_PUB = f"""WITH p AS (SELECT concat(upper(lang), '-', doc_id, '-A1') AS publication_number, upper(lang) AS country, doc_id, source,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 20000101 + doc_id % 28 + 10000 * (doc_id % 9) END AS day,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(floor(doc_id / 4) AS BIGINT)::VARCHAR END AS family_id, coalesce(text, '') AS abstract,
    coalesce({O.sentences('text')}[1], '') AS title, concat(upper(source), '/', doc_id % 7) AS code FROM documents)"""


@query(_PUB + """ SELECT publication_number AS canonical, country AS office, doc_id::VARCHAR AS number, title, 2::BIGINT AS n_claims, source AS assignee,
    CASE WHEN day IS NULL THEN NULL ELSE concat_ws('-', substr(day::VARCHAR, 1, 4), substr(day::VARCHAR, 5, 2), substr(day::VARCHAR, 7, 2)) END AS pub_date,
    concat_ws('; ', CASE WHEN title = '' THEN 'title missing' END, CASE WHEN abstract = '' THEN 'abstract missing' END) AS notes FROM p""")
def bq_row_mapping(spark, sf_dir):
    rows = records.from_publications(_publications(spark, sf_dir))
    return rows.select("canonical", "office", "number", "title", F.size("claims").cast("bigint").alias("n_claims"), "assignee", "pub_date", F.array_join("notes", "; ").alias("notes"))


@query(r"""WITH b AS (SELECT doc_id, concat('1. ', coalesce(text, ''), chr(10), ' 2 . Another one', chr(10), '12.Last') AS t FROM documents),
    s AS (SELECT doc_id, string_split(regexp_replace(t, '(^|\n)\s*(\d{1,3}\s*\.)', chr(1) || '\2', 'g'), chr(1)) AS p FROM b)
    SELECT doc_id, len(list_filter(p, lambda x: trim(x) <> ''))::BIGINT AS n_claims, trim(p[len(p)]) AS last_claim FROM s""")
def claims_blob_split(spark, sf_dir):
    blob = F.concat(F.lit("1. "), F.coalesce("text", F.lit("")), F.lit("\n 2 . Another one\n12.Last"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.claims(blob).alias("c"))
    return rows.select("doc_id", F.size("c").cast("bigint").alias("n_claims"), F.element_at("c", -1).alias("last_claim"))


@query(cte("v_records") + f" SELECT canonical, unnest(range(len(e)))::INTEGER AS pos, unnest(e) AS element FROM (SELECT canonical, {O.elements('claim')} AS e FROM v_records)")
def claim_elements(spark, sf_dir):
    return scoring.claim_elements(_records(spark, sf_dir))


@query(cte("v_records") + """ SELECT canonical, concat_ws(' | ', office, number, assignee, pub_date, nullif(legal_status, '')) AS one_line, (claim IS NOT NULL)::BIGINT AS claim_count,
    coalesce(claim, '') AS independent_claim, CASE WHEN claim IS NULL THEN 'no claims in the record' ELSE '' END AS note FROM v_records""")
def summary_one_line(spark, sf_dir):
    return records.summaries(_records(spark, sf_dir))


# ---- legal status ----

_LEGAL = cte("v_legal") + f""", e AS (SELECT *, {O.effect()} AS effect FROM v_legal),
    l AS (SELECT canonical, count(effect) AS n, arg_max(effect, pos) FILTER (effect IS NOT NULL) AS effect, arg_max(concat(date, ' ', code, ': ', description), pos) FILTER (effect IS NOT NULL) AS evidence FROM e GROUP BY 1),
    s AS (SELECT canonical, coalesce(effect, 'UNKNOWN') AS status, CASE WHEN effect <> 'UNKNOWN' THEN evidence END AS evidence FROM l)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal.classify(view(spark, sf_dir, "v_legal"))


@query(_LEGAL + " SELECT *, status = 'UNKNOWN' AS needs_review FROM s")
def legal_classify(spark, sf_dir):
    return _status(spark, sf_dir)


@query(_LEGAL + " SELECT *, status = 'UNKNOWN' AS needs_review FROM s")
def streaming_legal(spark, sf_dir):
    """Events as a stream of three batches in no order, the stream stopped and started between them."""
    events, path = view(spark, sf_dir, "v_legal"), monitor.new_folder(spark, "legal")
    for part in (2, 0, 1):
        events.filter(F.pmod(F.xxhash64("canonical", "pos"), F.lit(3)) == part).write.mode("append").json(f"{path}/in")
        legal_fold.follow(spark, f"{path}/in", f"{path}/out", f"{path}/mark").awaitTermination()
    return legal_fold.current(spark, f"{path}/out").select("canonical", "status", "evidence", "needs_review")


@query(_LEGAL + """ SELECT c_custkey::VARCHAR AS canonical, coalesce(status, 'UNKNOWN') AS legal_status, CASE WHEN status IS NULL THEN 'legal status: no record at the provider'
    WHEN status = 'UNKNOWN' THEN 'legal status UNKNOWN: not determined from events' ELSE concat('legal status evidence: ', evidence) END AS note FROM customer LEFT JOIN s ON s.canonical = c_custkey::VARCHAR""")
def legal_apply(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("canonical"))
    return legal.apply(rows, _status(spark, sf_dir)).select("canonical", "legal_status", F.element_at("notes", -1).alias("note"))


@query(_LEGAL + " SELECT canonical, status FROM s WHERE status IN ('LAPSED', 'EXPIRED', 'REVOKED')")
def dead_filter(spark, sf_dir):
    return _status(spark, sf_dir).filter(legal.is_final(F.col("status"))).select("canonical", "status")


# ---- text ----


@query(f"SELECT doc_id, len({O.tokens('text')})::BIGINT AS n_tokens, array_to_string({O.tokens('text')}, ' ') AS tokens FROM documents")
def token_sets(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.tokens(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH w AS (SELECT DISTINCT unnest({O.tokens('text')}) AS token FROM documents) SELECT {O.stem('token')} AS stem, count(*) AS n FROM w GROUP BY 1")
def stems(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return words.groupBy(T.stem(F.col("token")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, unnest(range(len(s)))::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {O.sentences('text')} AS s FROM documents)")
def sentences(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


_BEST = f"""WITH sn AS (SELECT doc_id, unnest(range(len(s)))::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {O.sentences('text')} AS s FROM documents)),
    st AS (SELECT DISTINCT doc_id, pos, unnest({O.tokens('sentence')}) AS token FROM sn), bt AS (SELECT item_id, unnest({O.tokens('text')}) AS token FROM benchmark),
    n AS (SELECT item_id, doc_id, pos, count(*) AS n FROM st JOIN bt USING (token) GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id, pos) AS k FROM n)"""


@query(_BEST + " SELECT item_id, doc_id, pos, n, left(sentence, 200) AS span FROM k JOIN sn USING (doc_id, pos) WHERE k = 1")
def best_evidence(spark, sf_dir):
    """Evidence over a whole corpus, by the rare tokens of what is asked first."""
    rows = sentences(spark, sf_dir)
    best = evidence.best_sentences(rows, _table(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows.join(best, ["doc_id", "pos"]).select("item_id", "doc_id", "pos", "n", F.substring("sentence", 1, 200).alias("span"))


# ---- judging and scoring ----


@query(JUDGED + " SELECT canonical, pos::INTEGER AS pos, v1 AS verdict, sp1 AS span, round(c1, 4) AS confidence, v1 = 'UNCLEAR' AS needs_review FROM j")
def judge_strict(spark, sf_dir):
    rows = judges.judge(scoring.claim_elements(_records(spark, sf_dir)), spec(spark))
    return rows.select("canonical", "pos", "strict.*").withColumn("confidence", F.round("confidence", 4))


@query(JUDGED + " SELECT canonical, pos::INTEGER AS pos, v2 AS verdict, sp2 AS span, round(c2, 4) AS confidence, v2 = 'UNCLEAR' AS needs_review FROM j")
def judge_lenient(spark, sf_dir):
    rows = judges.judge(scoring.claim_elements(_records(spark, sf_dir)), spec(spark))
    return rows.select("canonical", "pos", "recall.*").withColumn("confidence", F.round("confidence", 4))


_SPECS = cte("v_records") + f""", el AS (SELECT DISTINCT unnest({O.elements('claim')}) AS element FROM v_records),
    tk AS (SELECT element, len(t) AS n_terms, unnest(t) AS token FROM (SELECT element, {O.tokens('element')} AS t FROM el)), e AS (SELECT *, {O.stem('token')} AS e FROM tk),
    pt AS (SELECT DISTINCT page_id, unnest({O.tokens("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS token FROM pages), ps AS (SELECT DISTINCT page_id, {O.stem('token')} AS s FROM pt),
    v AS (SELECT a.e, b.s FROM (SELECT DISTINCT e FROM e) a, (SELECT DISTINCT s FROM ps) b WHERE a.e = b.s OR (length(a.e) >= 4 AND length(b.s) >= 4 AND (contains(b.s, a.e) OR contains(a.e, b.s)))),
    r AS (SELECT DISTINCT e, page_id FROM v JOIN ps USING (s))"""


@query(_SPECS + " SELECT element, page_id, n_terms::BIGINT AS n_terms, count(*) AS n_matched FROM e JOIN r USING (e) GROUP BY 1, 2, 3 HAVING count(*) / n_terms >= 0.4")
def lenient_specifications(spark, sf_dir):
    """All claim elements against every page as a specification."""
    specs = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("spec"))
    return judges.lenient_over(scoring.claim_elements(_records(spark, sf_dir)), specs, "page_id")


_COERCE = f"""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'maybe' WHEN 3 THEN NULL ELSE 'MATCH' END AS v,
    CASE doc_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN '1.7' WHEN 2 THEN '0.2' ELSE '0.75' END AS c, CASE doc_id % 4 WHEN 0 THEN 'red widget' WHEN 1 THEN 'made up' WHEN 2 THEN '' END AS s FROM documents),
    a AS (SELECT doc_id, CASE WHEN upper(v) IN ('MATCH', 'MISSING', 'UNCLEAR') THEN upper(v) ELSE 'UNCLEAR' END AS v, greatest(0.0, least(1.0, coalesce(try_cast(c AS DOUBLE), 0.0))) AS c, s FROM p),
    b AS (SELECT doc_id, v, CASE WHEN v = 'MISSING' AND coalesce(s, '') = '' THEN 1.0 ELSE c END AS c, CASE WHEN v <> 'MISSING' AND s <> '' AND contains({O.literal(SPEC)}, s) THEN s END AS s FROM a)"""


@query(_COERCE + " SELECT doc_id, CASE WHEN v = 'MATCH' AND (s IS NULL OR c < 0.3) THEN 'UNCLEAR' ELSE v END AS verdict, s AS span, c::DOUBLE AS confidence, (v = 'UNCLEAR' OR v = 'MATCH' AND (s IS NULL OR c < 0.3)) AS needs_review FROM b")
def coerce_payload(spark, sf_dir):
    k = F.col("doc_id")
    said = F.when(k % 5 == 0, "match").when(k % 5 == 1, "MISSING").when(k % 5 == 2, "maybe").when(k % 5 == 4, "MATCH")
    sure = F.when(k % 7 == 0, "high").when(k % 7 == 1, "1.7").when(k % 7 == 2, "0.2").otherwise("0.75")
    span = F.when(k % 4 == 0, "red widget").when(k % 4 == 1, "made up").when(k % 4 == 2, "")
    return _table(spark, sf_dir, "documents").select("doc_id", judges.coerce(said, sure, span, F.lit(SPEC)).alias("v")).select("doc_id", "v.*")


@query(JUDGED + " SELECT canonical, count(*) FILTER (v1 = 'MATCH') AS n_match, count(*) FILTER (v1 = 'MISSING') AS n_missing, count(*) FILTER (v1 = 'UNCLEAR') AS n_unclear FROM j GROUP BY 1")
def verdict_counts(spark, sf_dir):
    rows = judge_strict(spark, sf_dir)
    return rows.groupBy("canonical").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in evaluation.LABELS])


@query(JUDGED + """ SELECT canonical, count(*) AS n, count(*) FILTER (v1 = 'UNCLEAR') AS unclear FROM j GROUP BY 1
    UNION ALL SELECT canonical, 1, 1 FROM v_records WHERE canonical NOT IN (SELECT canonical FROM j)""")
def compare_placeholder(spark, sf_dir):
    return scoring.compare(_records(spark, sf_dir), spec(spark)).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "UNCLEAR").alias("unclear"))


@query(JUDGED + " SELECT canonical, pos::INTEGER AS pos, round(p1, 4) AS p_strict, round(p2, 4) AS p_recall, round(p, 4) AS p_coverage, round(agreement, 4) AS confidence, span, band, needs_review FROM f")
def fuse_channels(spark, sf_dir):
    return _fused(spark, sf_dir).select("canonical", "pos", r4("p_strict"), r4("p_recall"), r4("p_coverage"), r4("confidence"), "span", "band", "needs_review")


@query(JUDGED + " SELECT canonical, pos::INTEGER AS pos, array_to_string(m, ' ') AS terms FROM f")
def matched_terms(spark, sf_dir):
    return _fused(spark, sf_dir).select("canonical", "pos", F.array_join("matched_terms", " ").alias("terms"))


_SCORE = "canonical, n_elements, round(coverage, 4) AS coverage, round(low, 4) AS low, round(high, 4) AS high, round(least, 4) AS least, round(agreement, 4) AS agreement, gap_count, review_count, risk_band"


@query(JUDGED + f" SELECT {_SCORE} FROM sc")
def fto_triage(spark, sf_dir):
    """Claims against a specification, to a ranked risk table."""
    rows = scoring.triage(_scores(spark, sf_dir))
    return rows.select("canonical", "n_elements", *[r4(c) for c in ("coverage", "low", "high", "least", "agreement")], "gap_count", "review_count", "risk_band")


@query(JUDGED + """, wk AS (SELECT canonical, arg_min(element, (p, pos)) AS element, arg_min({'s': span}, (p, pos)).s AS span FROM f GROUP BY 1)
    SELECT canonical, -1 AS pos, CASE risk_band WHEN 'HIGH' THEN 'design_around' WHEN 'MEDIUM' THEN 'clarify' WHEN 'LOW' THEN 'monitor' ELSE 'obtain_claims' END AS category,
        CASE WHEN risk_band = 'HIGH' THEN coalesce(span, '') ELSE '' END AS basis, coalesce(element, '') AS about FROM sc LEFT JOIN wk USING (canonical)
    UNION ALL SELECT canonical, pos::INTEGER, CASE WHEN p < 0.3 THEN 'defence' ELSE 'interpretation' END, CASE WHEN p < 0.3 THEN '' ELSE coalesce(span, '') END, element FROM f WHERE p < 0.3 OR needs_review""")
def proposals(spark, sf_dir):
    return scoring.scored_proposals(_records(spark, sf_dir), _fused(spark, sf_dir, about=scoring.about()))


@query(JUDGED + " SELECT risk_band, count(*) AS n, sum(review_count)::BIGINT AS reviews FROM sc GROUP BY 1")
def band_banner(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"), F.sum("review_count").alias("reviews"))


@query(JUDGED + " SELECT canonical, min(pos)::INTEGER AS pos, arg_min(element, pos) AS element FROM (SELECT *, min(p) OVER (PARTITION BY canonical) AS lp FROM f) WHERE p = lp GROUP BY 1")
def weakest_element(spark, sf_dir):
    return scoring.weakest_element(_fused(spark, sf_dir)).select("canonical", "pos", "element")


@query(JUDGED + " SELECT canonical, pos::INTEGER AS pos, element, '' AS verdict, '' AS evidence_span FROM j")
def worksheet_export(spark, sf_dir):
    rows = scoring.claim_elements(_records(spark, sf_dir))
    return rows.select("canonical", "pos", "element", F.lit("").alias("verdict"), F.lit("").alias("evidence_span"))


@query(JUDGED + """, ws AS (SELECT DISTINCT element AS e, 'MATCH' AS v, 'red widget' AS s FROM j WHERE contains(element, 'red'))
    SELECT canonical, pos::INTEGER AS pos, coalesce(v, 'UNCLEAR') AS verdict, s AS span FROM j LEFT JOIN ws ON e = trim(element)""")
def worksheet_join(spark, sf_dir):
    """Verdicts filled in by hand, looked up by element; what isn't filled in is unclear."""
    rows = scoring.claim_elements(_records(spark, sf_dir))
    filled = rows.filter(F.contains("element", F.lit("red"))).select(F.trim("element").alias("e")).distinct().withColumn("v", F.lit("MATCH"))
    joined = rows.join(filled, F.trim("element") == F.col("e"), "left")
    checked = judges.coerce(F.coalesce("v", F.lit("UNCLEAR")), F.lit("0.9"), F.when(F.col("v").isNotNull(), "red widget"), F.lit(SPEC))
    return joined.select("canonical", "pos", checked["verdict"].alias("verdict"), checked["span"].alias("span"))


@query(JUDGED + """, w0 AS (SELECT canonical, pos, p1, CASE WHEN contains(element, 'red') THEN 'MATCH' ELSE 'UNCLEAR' END AS verdict, CASE WHEN contains(element, 'red') THEN 0.9 ELSE 0.0 END AS p2 FROM f)
    SELECT canonical, pos::INTEGER AS pos, verdict, p2::DOUBLE AS p_recall, round((p1 + p2) / 2, 6) AS p_coverage FROM w0""")
def worksheet_judge(spark, sf_dir):
    """A filled worksheet as the recall channel, fused with the strict one."""
    elements = scoring.claim_elements(_records(spark, sf_dir))
    filled = elements.filter(F.contains("element", F.lit("red"))).select(F.trim("element").alias("element")).distinct()
    filled = filled.select(F.lit(None).cast("string").alias("canonical"), "element", F.lit("MATCH").alias("verdict"), F.lit("red widget").alias("evidence_span"), F.lit("0.9").alias("confidence"))
    one = spec(spark)
    fused = judges.fuse(judges.by_worksheet(judges.judge(elements, one), filled, one))
    return fused.select("canonical", "pos", F.col("recall.verdict").alias("verdict"), "p_recall", F.round("p_coverage", 6).alias("p_coverage"))


# ---- search ----

_HITS = """, k AS (SELECT *, contains(lower(title), 'thion') OR contains(lower(title), 'the') AS t1, contains(lower(abstract), 'thion') OR contains(lower(abstract), 'the') AS a1,
    contains(lower(title), 'nder') OR contains(lower(title), 'ering') AS t2, contains(lower(abstract), 'nder') OR contains(lower(abstract), 'ering') AS a2 FROM p),
    r AS (SELECT publication_number, family_id, doc_id, CASE WHEN t1 THEN 3 WHEN a1 THEN 1 ELSE 0 END + CASE WHEN t2 THEN 3 WHEN a2 THEN 1 ELSE 0 END
      + CASE WHEN starts_with(code, 'SRC1') THEN 2 ELSE 0 END + CASE WHEN starts_with(code, 'SRC2/3') THEN 2 ELSE 0 END AS score, (t1 OR a1)::INT + (t2 OR a2)::INT AS hit, k.* EXCLUDE (publication_number, family_id, doc_id) FROM k)"""


@query(_PUB + _HITS + " SELECT publication_number, title FROM r WHERE country IN ('EN', 'DE') AND day >= 20010101 AND hit = 2 AND (starts_with(code, 'SRC1') OR starts_with(code, 'SRC2/3')) ORDER BY 1 LIMIT 5000")
def search_filter(spark, sf_dir):
    return search.search(_publications(spark, sf_dir), BRIEF).select("publication_number", F.col("title_localized")[1]["text"].alias("title"))


@query(_PUB + _HITS + " SELECT publication_number, title FROM r WHERE country IN ('EN', 'DE') AND day >= 20010101 AND hit = 2 AND (starts_with(code, 'SRC1') OR starts_with(code, 'SRC2/3')) ORDER BY 1 LIMIT 5000")
def search_by_sql(spark, sf_dir):
    """The brief as SQL with parameters, run from its entry in a log."""
    logged = search.search_sql(BRIEF, ("publication_number", "title_localized[1].text AS title")).logged()
    return search.SearchSql.from_log(logged).run(_publications(spark, sf_dir))


def _briefs(spark: SparkSession, sf_dir: str) -> dict[int, search.Brief]:
    """A saved search for each item of the benchmark: two groups of two words, and by its number a class, a country, a date."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.slice(words, 1, 4).alias("w")).filter("size(w) = 4").collect()
    out = {}
    for i, w in sorted((r["item_id"], r["w"]) for r in items):
        out[i] = search.Brief(
            name=f"item {i}", keywords=(tuple(w[:2]), tuple(w[2:])), cpc=(f"SRC{i % 20}",) if i % 3 == 0 else (), countries=("en",) if i % 4 == 1 else (),
            date_from="2004-01-01" if i % 5 == 2 else None, limit=20 if i % 2 == 0 else 5000,
        )
    return out


_SAID = "contains('titre', w[{0}]) OR contains(lower(title), w[{0}]) OR contains(lower(abstract), w[{0}])"


@query(_PUB + f""", b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM benchmark),
    h AS (SELECT item_id, publication_number, row_number() OVER (PARTITION BY item_id ORDER BY publication_number) AS k FROM b, p WHERE len(w) >= 4
        AND ({_SAID.format(1)} OR {_SAID.format(2)}) AND ({_SAID.format(3)} OR {_SAID.format(4)}) AND (item_id % 3 <> 0 OR starts_with(code, concat('SRC', item_id % 20)))
        AND (item_id % 4 <> 1 OR country = 'EN') AND (item_id % 5 <> 2 OR day >= 20040101))
    SELECT item_id, publication_number FROM h WHERE k <= CASE WHEN item_id % 2 = 0 THEN 20 ELSE 5000 END""")
def watch_percolate(spark, sf_dir):
    """All saved searches over all publications in one pass."""
    briefs = _briefs(spark, sf_dir)
    numbers = spark.createDataFrame(list(enumerate(briefs)), "brief int, item_id long")
    hits = percolate.percolate(_publications(spark, sf_dir), list(briefs.values()))
    return hits.join(F.broadcast(numbers), "brief").select("item_id", "publication_number")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_publications(spark, sf_dir), BRIEF)


@query(_PUB + _HITS + " SELECT publication_number, family_id, score::BIGINT AS score, hit::BIGINT AS groups_hit, 2::BIGINT AS groups_total, hit < 2 AS needs_review FROM r")
def search_rank(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query()
def rank_evidence(spark, sf_dir):
    """What each score rests on; rows only, as the snippets are held against the rules in the tests."""
    return search.explained(_publications(spark, sf_dir), BRIEF).select("publication_number", "score", "matched_terms", "evidence", "notes")


def _first_word(said: pd.Series, text: str) -> pd.DataFrame:
    """A judge for trial: an element is met if its first word stands in the specification."""
    word = said.str.split(" ").str[0]
    met = word.map(lambda w: bool(w) and w in text, na_action="ignore").eq(True)
    label = pd.Series("MISSING", said.index).mask(met, "MATCH").mask(word.isna() | word.eq(""))
    return pd.DataFrame({"label": label, "confidence": pd.Series("0.9", said.index).where(met), "span": word.where(met)})


@query(f"""WITH w AS (SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS word FROM part), m AS (SELECT *, contains({O.literal(SPEC)}, word) AS met FROM w)
    SELECT p_partkey, CASE WHEN word IS NULL THEN 'UNCLEAR' WHEN met THEN 'MATCH' ELSE 'MISSING' END AS verdict, CASE WHEN met THEN word END AS span,
    CASE WHEN word IS NULL THEN 0.0 WHEN met THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence, word IS NULL AS needs_review FROM m""")
def custom_judge_udf(spark, sf_dir):
    elements = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("element"))
    return judges.judged_by(elements, SPEC, _first_word).drop("element")


_FAMILY = _PUB + _HITS + """, b AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY score DESC, publication_number DESC) AS k, list(publication_number) OVER (PARTITION BY family_id) AS l FROM r)"""


@query(_FAMILY + """ SELECT publication_number, score::BIGINT AS score, CASE WHEN family_id IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(l, lambda x: x <> publication_number)), ',') END AS siblings
    FROM b WHERE family_id IS NULL OR k = 1""")
def family_dedupe(spark, sf_dir):
    return search.one_per_family(_ranked(spark, sf_dir)).select("publication_number", "score", F.array_join("siblings", ",").alias("siblings"))


@query(_FAMILY + " SELECT publication_number AS number, concat('score ', score) AS note FROM b WHERE (family_id IS NULL OR k = 1) AND score > 0")
def candidates_csv(spark, sf_dir):
    rows = search.one_per_family(_ranked(spark, sf_dir)).filter("score > 0")
    return rows.select(F.col("publication_number").alias("number"), F.concat(F.lit("score "), F.col("score").cast("string")).alias("note"))


_TF = "WITH " + O.tfidf(QUERY)


@query(_TF + " SELECT id, count(*) AS terms, round(sum(weight), 6) AS weight, round(max(weight), 6) AS most FROM w GROUP BY 1")
def tfidf_weights(spark, sf_dir):
    weights, _ = search.tfidf(_table(spark, sf_dir, "documents"), QUERY)
    return weights.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.max("weight"), 6).alias("most"))


@query(_TF + " SELECT id, round(semantic, 6) AS semantic FROM sem")
def semantic_scores(spark, sf_dir):
    return search.similarity(_table(spark, sf_dir, "documents"), QUERY).select("id", F.round("semantic", 6).alias("semantic"))


@query(_PUB.replace("WITH p AS", "WITH p AS", 1) + _HITS + ", " + O.tfidf(QUERY) + """, m AS (SELECT r.doc_id AS id, score, semantic, score / coalesce(nullif(max(score) OVER (), 0), 1) AS kn, semantic / coalesce(nullif(max(semantic) OVER (), 0), 1) AS sn FROM r JOIN sem ON sem.id = r.doc_id)
    SELECT id, score::BIGINT AS score, round(semantic, 6) AS semantic, round((kn + sn) / 2, 6) AS combined, abs(kn - sn) > 0.5 AS needs_review FROM m""")
def semantic_fusion(spark, sf_dir):
    keyword = _ranked(spark, sf_dir).select(F.split("publication_number", "-")[1].cast("bigint").alias("id"), "score")
    rows = search.fused(keyword, search.similarity(_table(spark, sf_dir, "documents"), QUERY))
    return rows.withColumn("semantic", F.round("semantic", 6)).withColumn("combined", F.round("combined", 6))


_DENSE = ", d AS (" + O.hashed_counts("SELECT doc_id AS id, text FROM documents", 256) + "), dq AS (" + O.hashed_counts(f"SELECT 0 AS id, '{QUERY}' AS text", 256) + """),
    dn AS (SELECT id, sqrt(sum(c * c)) AS norm FROM d GROUP BY 1), dp AS (SELECT d.id, sum(d.c * dq.c) AS dot FROM d JOIN dq ON dq.bucket = d.bucket GROUP BY 1),
    dsem AS (SELECT x.doc_id AS id, coalesce(dot / (norm * (SELECT sqrt(sum(c * c)) FROM dq)), 0.0) AS semantic FROM documents x LEFT JOIN dn ON dn.id = x.doc_id LEFT JOIN dp ON dp.id = x.doc_id)"""


@query(_PUB + _HITS + _DENSE + """, m AS (SELECT r.doc_id AS id, score, semantic, score / coalesce(nullif(max(score) OVER (), 0), 1) AS kn, semantic / coalesce(nullif(max(semantic) OVER (), 0), 1) AS sn FROM r JOIN dsem ON dsem.id = r.doc_id)
    SELECT id, score::BIGINT AS score, round(semantic, 6) AS semantic, round((kn + sn) / 2, 6) AS combined, abs(kn - sn) > 0.5 AS needs_review FROM m""")
def dense_fusion(spark, sf_dir):
    """Keywords and the vectors of an embedder, over whole texts."""
    keyword = _ranked(spark, sf_dir).select(F.split("publication_number", "-")[1].cast("bigint").alias("id"), "score")
    rows = search.fused(keyword, embedders.dense_similarity(_table(spark, sf_dir, "documents"), QUERY, embedders.EMBEDDERS["hash"]))
    return rows.withColumn("semantic", F.round("semantic", 6)).withColumn("combined", F.round("combined", 6))


@query("""SELECT a.vec_id, b.vec_id AS query_id, round(greatest(0.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
    FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b""")
def embedding_cosine(spark, sf_dir):
    """Every vector whose id is divisible by 50 against all vectors."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.cosines(rows, asked).withColumn("cosine", F.round("cosine", 6))


_SDI = cte("v_runs") + ", h AS (SELECT DISTINCT theme, run_date, pub FROM v_runs), d AS (SELECT theme, max(run_date) AS last FROM h GROUP BY 1)"


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hits of the last run of each theme, and the seen table of those before."""
    rows = view(spark, sf_dir, "v_runs").distinct()
    last = rows.groupBy("theme").agg(F.max("run_date").alias("last"))
    rows = rows.join(last, "theme")
    seen = rows.filter("run_date < last").groupBy("theme", "pub").agg(F.min("run_date").alias("first_seen"))
    return rows.filter("run_date = last").drop("last"), seen


@query(_SDI + " SELECT theme, run_date, pub FROM h JOIN d USING (theme) WHERE run_date = last AND NOT EXISTS (SELECT 1 FROM h o WHERE o.theme = h.theme AND o.pub = h.pub AND o.run_date < last)")
def sdi_new_hits(spark, sf_dir):
    return search.split_seen(*_hits(spark, sf_dir))[0]


@query(_SDI + " SELECT theme, pub, min(run_date) AS first_seen FROM h GROUP BY 1, 2")
def sdi_seen_state(spark, sf_dir):
    hits, seen = _hits(spark, sf_dir)
    return search.absorb(seen, hits)


@query(_SDI + ", f AS (SELECT *, min(run_date) OVER (PARTITION BY theme, pub) AS first FROM h) SELECT theme, run_date, count(*) AS hits, count(*) FILTER (first = run_date) AS new FROM f GROUP BY 1, 2")
def sdi_runs(spark, sf_dir):
    rows = view(spark, sf_dir, "v_runs").distinct()
    first = F.min("run_date").over(Window.partitionBy("theme", "pub"))
    return rows.withColumn("first", first).groupBy("theme", "run_date").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("first") == F.col("run_date")).alias("new"))


@query(_SDI + " SELECT theme, pub, min(run_date) AS first_seen FROM h GROUP BY 1, 2")
def streaming_sdi(spark, sf_dir):
    """The watch as a stream: what earlier runs found comes in first, then each theme's last run."""
    now, before = _hits(spark, sf_dir)
    path = monitor.new_folder(spark, "watch")
    for arrived in (before.withColumnRenamed("first_seen", "run_date"), now):
        arrived.select("theme", "run_date", "pub").write.mode("append").json(f"{path}/in")
        monitor.watch(spark, f"{path}/in", f"{path}/state", f"{path}/mark").awaitTermination()
    return spark.read.parquet(f"{path}/state/seen").groupBy("theme", "pub").agg(F.min("first_seen").alias("first_seen"))


# ---- snapshots ----

_J = """concat('{"family_id":', CASE WHEN family_id IS NULL THEN 'null' ELSE concat('"', family_id, '"') END, ',"legal_status":"', legal_status, '"}')"""
_SNAP = cte("v_snapshots") + f""", s AS (SELECT *, sha256({_J}) AS content_hash FROM v_snapshots),
    l AS (SELECT *, lag(content_hash) OVER w AS before, lag(legal_status) OVER w AS b1, lag(family_id) OVER w AS b2, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY canonical ORDER BY fetched_at))"""
_FIELDS = ("family_id", "legal_status")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.hashed(view(spark, sf_dir, "v_snapshots"), _FIELDS)


@query(_SNAP + " SELECT canonical, fetched_at, content_hash FROM s")
def content_hash(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("canonical", "fetched_at", "content_hash")


@query(_SNAP + " SELECT canonical, fetched_at, before IS NULL AS is_new FROM l WHERE before IS DISTINCT FROM content_hash")
def snapshot_changes(spark, sf_dir):
    return state.changes(_snapshots(spark, sf_dir)).select("canonical", "fetched_at", "is_new")


@query(_SNAP + " SELECT canonical, max(fetched_at) AS fetched_at, arg_max(content_hash, fetched_at) AS content_hash FROM s GROUP BY 1")
def snapshot_latest(spark, sf_dir):
    return state.latest(_snapshots(spark, sf_dir)).select("canonical", "fetched_at", "content_hash")


@query(_SNAP + " SELECT canonical, fetched_at, content_hash FROM l WHERE before IS DISTINCT FROM content_hash")
def streaming_snapshots(spark, sf_dir):
    """The monitor as a stream: snapshots up to the end of 1994 come in first, then the later ones."""
    rows = _snapshots(spark, sf_dir).select("canonical", "fetched_at", "content_hash")
    path = monitor.new_folder(spark, "snapshots")
    for arrived in (rows.filter("fetched_at < '1995'"), rows.filter("fetched_at >= '1995'")):
        arrived.write.mode("append").json(f"{path}/in")
        monitor.snapshots(spark, f"{path}/in", f"{path}/store", f"{path}/mark").awaitTermination()
    return spark.read.parquet(f"{path}/store").select("canonical", "fetched_at", "content_hash")


_DIFF = _SNAP + """, c AS (SELECT canonical, fetched_at, 'legal_status' AS field, b1 AS before, legal_status AS after, 'changed' AS kind FROM l WHERE k > 1 AND b1 IS DISTINCT FROM legal_status
    UNION ALL SELECT canonical, fetched_at, 'family_id', b2, family_id, 'changed' FROM l WHERE k > 1 AND b2 IS DISTINCT FROM family_id)"""


@query(_DIFF + " SELECT * FROM c")
def history_diff(spark, sf_dir):
    return state.scalar_changes(state.adjacent(_snapshots(spark, sf_dir), _FIELDS), _FIELDS)


@query(_DIFF + " SELECT * FROM c")
def streaming_monitor(spark, sf_dir):
    """Fetched records as a stream: those up to the end of 1994 come in first, then the later ones; what changed when."""
    rows, path = view(spark, sf_dir, "v_snapshots"), monitor.new_folder(spark, "records")
    for arrived in (rows.filter("fetched_at < '1995'"), rows.filter("fetched_at >= '1995'")):
        arrived.write.mode("append").json(f"{path}/in")
        monitor.records(spark, f"{path}/in", f"{path}/store", f"{path}/mark").awaitTermination()
    return spark.read.parquet(f"{path}/store/changes").drop("batch")


_CLAIMS = cte("v_records") + """, v AS (SELECT canonical, CASE WHEN claim IS NULL THEN [] WHEN p_partkey % 4 = 1 THEN [claim] ELSE [claim, title] END AS o,
    CASE WHEN p_partkey % 4 = 0 THEN [claim, assignee] WHEN p_partkey % 4 = 1 THEN [claim, title, assignee] WHEN p_partkey % 4 = 2 THEN [claim] ELSE [claim, title] END AS n FROM v_records),
    x AS (SELECT canonical, unnest(range(greatest(len(o), len(n)))) AS i, o, n FROM v)"""


@query(_CLAIMS + """ SELECT canonical, concat('claims[', i, ']') AS field, CASE WHEN i >= len(o) OR o[i + 1] IS NULL THEN 'added' WHEN i >= len(n) OR n[i + 1] IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM x WHERE o[i + 1] IS DISTINCT FROM n[i + 1]""")
def claims_positional_diff(spark, sf_dir):
    rows, k = _records(spark, sf_dir), F.col("p_partkey") % 4
    old = F.when(F.col("claim").isNull(), F.array().cast("array<string>")).when(k == 1, F.array("claim")).otherwise(F.array("claim", "title"))
    new = F.when(k == 0, F.array("claim", "assignee")).when(k == 1, F.array("claim", "title", "assignee")).when(k == 2, F.array("claim")).otherwise(F.array("claim", "title"))
    pairs = rows.select("canonical", F.lit("now").alias("fetched_at"), F.struct(old.alias("claims")).alias("old"), F.struct(new.alias("claims")).alias("new"))
    return state.claim_changes(pairs).select("canonical", "field", "kind")


@query(_DIFF + " SELECT canonical, field AS base, count(*) AS n FROM c GROUP BY 1, 2")
def diff_by_field(spark, sf_dir):
    return state.by_field(history_diff(spark, sf_dir))


@query(_SNAP + """, e AS (SELECT canonical, arg_max(content_hash, fetched_at) AS h FROM s WHERE substr(fetched_at, 1, 4) < '1998' GROUP BY 1), n AS (SELECT canonical, arg_max(content_hash, fetched_at) AS h FROM s GROUP BY 1)
    SELECT count(*) AS fetched, count(*) FILTER (e.h IS NULL) AS new, count(*) FILTER (e.h <> n.h) AS changed, count(*) FILTER (e.h = n.h) AS unchanged FROM n LEFT JOIN e USING (canonical)""")
def monitor_counters(spark, sf_dir):
    rows = _snapshots(spark, sf_dir)
    saved = state.to_save(state.latest(rows), rows.filter(F.substring("fetched_at", 1, 4) < "1998"))
    return saved.agg(F.count(F.lit(1)).alias("fetched"), F.count_if("is_new").alias("new"), F.count_if("changed").alias("changed"), F.count_if(~F.col("is_new") & ~F.col("changed")).alias("unchanged"))


# ---- evaluation, gates, costs ----

_EVAL = JUDGED + """, g AS (SELECT canonical AS "case", s AS element_substring, e AS expected FROM v_records, (VALUES ('Housing', 'MATCH'), ('carrier', 'UNCLEAR'), ('no such', 'MISSING'), ('hold', 'MATCH')) t(s, e)),
    a AS (SELECT g.*, row_number() OVER (PARTITION BY "case", element_substring ORDER BY pos NULLS LAST) AS k, coalesce(v1, 'MISSING') AS actual FROM g LEFT JOIN j ON j.canonical = "case" AND contains(lower(element), lower(element_substring))),
    ev AS (SELECT *, expected = actual AS agreed FROM a WHERE k = 1)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = spark.createDataFrame([("Housing", "MATCH"), ("carrier", "UNCLEAR"), ("no such", "MISSING"), ("hold", "MATCH")], "element_substring string, expected string")
    labels = view(spark, sf_dir, "v_records").select(F.col("canonical").alias("case")).crossJoin(F.broadcast(golden))
    verdicts = judges.judge(scoring.claim_elements(_records(spark, sf_dir)), spec(spark)).select(F.col("canonical").alias("case"), "pos", "element", F.col("strict.verdict").alias("verdict"))
    return evaluation.matched_labels(labels, verdicts)


_CELLS = _EVAL + ", l AS (SELECT unnest(['MATCH', 'MISSING', 'UNCLEAR']) AS x), cell AS (SELECT a.x AS expected, b.x AS actual, (SELECT count(*) FROM ev WHERE ev.expected = a.x AND ev.actual = b.x) AS n FROM l a, l b)"


@query(_CELLS + " SELECT * FROM cell")
def eval_confusion(spark, sf_dir):
    return evaluation.confusion(_evaluated(spark, sf_dir))


@query(_CELLS + """ SELECT x AS label, coalesce((SELECT sum(n) FROM cell WHERE expected = x AND actual = x) / nullif((SELECT sum(n) FROM cell WHERE actual = x), 0), 0.0)::DOUBLE AS precision,
    coalesce((SELECT sum(n) FROM cell WHERE expected = x AND actual = x) / nullif((SELECT sum(n) FROM cell WHERE expected = x), 0), 0.0)::DOUBLE AS recall FROM l""")
def eval_precision_recall(spark, sf_dir):
    return evaluation.precision_recall(eval_confusion(spark, sf_dir))


@query(_EVAL + " SELECT coalesce(avg(agreed::INT), 0.0)::DOUBLE AS accuracy, count(*) FILTER (agreed) AS agreed, count(*) AS total FROM ev")
def eval_accuracy(spark, sf_dir):
    return evaluation.accuracy(_evaluated(spark, sf_dir))




@query(JUDGED + ", nn AS (" + _NUM.replace("WITH v_numbers AS", "WITH v_numbers AS", 1) + """ SELECT * FROM n), g AS (SELECT 'G-NORMALIZE-REVIEW' AS gate, count(*) AS checked FROM nn UNION ALL SELECT 'G-PROVENANCE', count(*) FROM v_records UNION ALL SELECT 'G-DISCLAIMER', count(*) FROM v_records
    UNION ALL SELECT 'G-NO-GUESS', count(*) FROM j UNION ALL SELECT 'G-EVIDENCE-SUBSTRING', count(*) FROM j UNION ALL SELECT 'G-UNCLEAR-REVIEW', count(*) FROM j UNION ALL SELECT 'G-SNAPSHOT-STABLE', count(*) FROM v_records)
    SELECT gate, true AS passed, checked, 0::BIGINT AS violations FROM g""")
def gates(spark, sf_dir):
    rows = _records(spark, sf_dir)
    verdicts = judges.judge(scoring.claim_elements(rows), spec(spark)).select("canonical", "strict.*")
    reports = records.summaries(rows).select(F.concat_ws("\n", "one_line", F.lit(markdown.DISCLAIMER)).alias("text"))
    hashed = state.hashed(rows, ("abstract", "assignee", "claims", "title")).select("canonical", "content_hash", F.lit("1").alias("fetched_at"))
    return evaluation.gates(_numbers(spark, sf_dir), rows.withColumn("source", F.lit("fixture")), verdicts, SPEC, reports, markdown.DISCLAIMER, state.to_save(hashed, hashed))


@query(JUDGED + ", nn AS (" + _NUM + """ SELECT * FROM n), v AS (SELECT v1, pos FROM j), g AS (
    SELECT 'G-NORMALIZE-REVIEW' AS gate, count(*) AS checked, count(*) FILTER ((confidence < 0.85 OR office = 'UNKNOWN') AND p_partkey % 5 = 0) AS violations FROM nn
    UNION ALL SELECT 'G-PROVENANCE', count(*), count(*) FILTER (p_partkey % 41 = 0) FROM v_records UNION ALL SELECT 'G-DISCLAIMER', count(*), count(*) FILTER (p_partkey % 13 = 0) FROM v_records
    UNION ALL SELECT 'G-NO-GUESS', count(*), count(*) FILTER (v1 = 'MATCH' AND pos % 2 = 0) FROM v UNION ALL SELECT 'G-EVIDENCE-SUBSTRING', count(*), count(*) FILTER (v1 = 'UNCLEAR' AND pos % 2 = 1) FROM v
    UNION ALL SELECT 'G-UNCLEAR-REVIEW', count(*), count(*) FILTER (v1 = 'UNCLEAR' AND pos = 2) FROM v UNION ALL SELECT 'G-SNAPSHOT-STABLE', count(*), count(*) FILTER (p_partkey % 17 = 0) FROM v_records)
    SELECT gate, violations = 0 AS passed, checked, violations FROM g""")
def gates_observed(spark, sf_dir):
    """Violations planted in every table of a run, found while the tables are written."""
    rows = _records(spark, sf_dir)
    key = F.col("p_partkey")
    verdicts = judges.judge(scoring.claim_elements(rows), spec(spark)).select("canonical", "pos", "strict.*")
    match, unclear = F.col("verdict") == "MATCH", F.col("verdict") == "UNCLEAR"
    span = F.when(match & (F.col("pos") % 2 == 0), None).when(unclear & (F.col("pos") % 2 == 1), "made up").otherwise(F.col("span"))
    reports = records.summaries(rows).join(rows.select("canonical", "p_partkey"), "canonical")
    hashed = lambda r: state.hashed(r, ("abstract", "assignee", "claims", "title")).select("canonical", "content_hash", F.lit("1").alias("fetched_at"))
    other = rows.withColumn("assignee", F.when(key % 17 == 0, "someone else").otherwise(F.col("assignee")))
    tables = {
        "numbers": _numbers(spark, sf_dir).withColumn("needs_review", F.col("needs_review") & (key % 5 != 0)),
        "records": rows.withColumn("source", F.when(key % 41 == 0, "").otherwise("fixture")),
        "verdicts": verdicts.withColumn("span", span).withColumn("needs_review", unclear & (F.col("pos") != 2)),
        "reports": reports.select(F.concat_ws("\n", "one_line", F.when(key % 13 != 0, markdown.DISCLAIMER)).alias("text")),
        "saved_twice": state.to_save(hashed(other), hashed(rows)),
    }
    found = evaluation.written_and_gated(tables, SPEC, markdown.DISCLAIMER, monitor.new_folder(spark, "gates"))
    return spark.createDataFrame(found, "gate string, passed boolean, checked long, violations long")


@query()
def fingerprint(spark, sf_dir):
    """One hash for a run; two runs over the same input agree whatever the partitioning."""
    return evaluation.fingerprint(fto_triage(spark, sf_dir), "canonical", "coverage", "low", "high", "gap_count", "risk_band")


@query(r"""WITH t AS (SELECT CAST(floor(coalesce(len(regexp_extract_all(text, '\S+')), 0) * 1.3::DOUBLE) AS BIGINT) AS t FROM documents)
    SELECT count(*) AS docs, sum(t)::BIGINT AS tokens, (sum(t) // count(*))::BIGINT AS average, round(sum(t) / 1000 * 0.003, 6)::DOUBLE AS cost FROM t""")
def token_cost(spark, sf_dir):
    return evaluation.token_costs(_table(spark, sf_dir, "documents"), F.col("text")).withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@query("SELECT event_type AS stage, median(value) AS median_value, count(*) AS runs FROM events GROUP BY 1")
def bench_median(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.median("value").alias("median_value"), F.count(F.lit(1)).alias("runs"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS title,
    CASE WHEN regexp_matches(lower(url), '^https?://') THEN url END AS link, regexp_replace(url, '[/\\:]', '_', 'g') AS file FROM pages""")
def html_title_extract(spark, sf_dir):
    title = T.escaped(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    return _table(spark, sf_dir, "pages").select("page_id", title.alias("title"), T.safe_link(F.col("url")).alias("link"), T.safe_name(F.col("url")).alias("file"))


# ---- reports and streams ----


@query(_DIFF + """, t AS (SELECT canonical, fetched_at, field, concat('| ', fetched_at, ' | ', field, ' | changed | ', coalesce(before, ''), ' | ', coalesce(after, ''), ' |') AS line FROM c)
    SELECT canonical, concat('## ', canonical, chr(10), chr(10), '| When | Field | Kind | Before | After |', chr(10), '|---|---|---|---|---|', chr(10),
        string_agg(line, chr(10) ORDER BY fetched_at, field), chr(10), chr(10), 'Screening support only; not a legal conclusion.') AS text FROM t GROUP BY 1""")
def diff_report(spark, sf_dir):
    return markdown.diff_reports(history_diff(spark, sf_dir))


@query(_SDI + """, nw AS (SELECT theme, pub FROM h JOIN d USING (theme) WHERE run_date = last AND NOT EXISTS (SELECT 1 FROM h o WHERE o.theme = h.theme AND o.pub = h.pub AND o.run_date < last)),
    l AS (SELECT theme, string_agg(concat('- ', pub), chr(10) ORDER BY pub) AS t FROM nw GROUP BY 1)
    SELECT theme, concat('## ', theme, chr(10), chr(10), coalesce(t, 'No change since the last run.'), chr(10), chr(10), 'Screening support only; not a legal conclusion.') AS text FROM d LEFT JOIN l USING (theme)""")
def watch_report(spark, sf_dir):
    return markdown.watch_reports(view(spark, sf_dir, "v_runs"), search.split_seen(*_hits(spark, sf_dir))[0])


@query()
def patent_report(spark, sf_dir):
    fused, scores = _fused(spark, sf_dir), _scores(spark, sf_dir)
    verdicts = fused.select("canonical", "pos", "element", "strict.*")
    return markdown.patent_reports(records.summaries(_records(spark, sf_dir)), fused, scoring.proposals(scores, fused), scores, verdicts)


@query(JUDGED + """, c AS (SELECT count(*) AS n, sum(review_count) AS r, count(*) FILTER (risk_band = 'HIGH') AS h, count(*) FILTER (risk_band = 'MEDIUM') AS m, count(*) FILTER (risk_band = 'LOW') AS l, count(*) FILTER (risk_band = 'UNKNOWN') AS u FROM sc)
    SELECT concat('<p>', concat_ws(', ', concat('patents: ', n), CASE WHEN h > 0 THEN concat('HIGH: ', h) END, CASE WHEN m > 0 THEN concat('MEDIUM: ', m) END, CASE WHEN l > 0 THEN concat('LOW: ', l) END,
        CASE WHEN u > 0 THEN concat('UNKNOWN: ', u) END, CASE WHEN r > 0 THEN concat('to review: ', r::BIGINT) END), '</p>') AS html FROM c""")
def pages_banner(spark, sf_dir):
    return pages.banner(_scores(spark, sf_dir))


@query()
def pages_index(spark, sf_dir):
    return pages.index_rows(_records(spark, sf_dir), _scores(spark, sf_dir))


_RANKED = JUDGED + """, k AS (SELECT canonical, row_number() OVER (ORDER BY CASE risk_band WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 WHEN 'UNKNOWN' THEN 3 ELSE 9 END, round(coverage, 9) DESC, canonical) AS rank FROM sc)"""


@query(JUDGED + """ SELECT canonical, CASE WHEN n_elements = 0 THEN 'No claim elements are known, so there is no score: get the claims by hand.'
    WHEN risk_band = 'HIGH' THEN concat('All ', n_elements, ' elements of the independent claim are covered well and none is plainly missing: by the all-elements rule a literal reading is possible. Have it examined.')
    WHEN risk_band = 'MEDIUM' THEN concat(gap_count, ' of ', n_elements, ' elements are thin: equivalents and differences of design are to be examined.')
    ELSE concat(gap_count, ' of ', n_elements, ' elements are plainly missing: by the all-elements rule a literal reading is unlikely.') END AS rationale FROM sc""")
def score_rationale(spark, sf_dir):
    return _scores(spark, sf_dir).select("canonical", scoring.rationale().alias("rationale"))


@query(JUDGED + """ SELECT canonical, pos::INTEGER AS pos, concat('coverage ', round_even(100 * p, 0)::INT, '% (recall ', round_even(100 * p2, 0)::INT, '%, strict ', round_even(100 * p1, 0)::INT, '%), agreement ',
    round_even(100 * agreement, 0)::INT, '%', CASE WHEN p >= 0.6 AND span IS NULL THEN '; partial only, as no span shows it' ELSE '' END) AS rationale FROM f""")
def element_rationale(spark, sf_dir):
    return _fused(spark, sf_dir).select("canonical", "pos", scoring.element_rationale().alias("rationale"))


@query(_RANKED + " SELECT * FROM k")
def triage_numbers(spark, sf_dir):
    """The place of each record in triage order; coverages that only differ by how a mean was summed are equal."""
    rows = _scores(spark, sf_dir).select("canonical", "risk_band", F.round("coverage", 9).alias("coverage"))
    return ranks.numbered(rows, scoring.triage_rank(), F.desc("coverage"), "canonical").select("canonical", "rank")


@query(_RANKED + """, g AS (SELECT ((rank - 1) // 50 + 1)::BIGINT AS number, count(*) AS n, arg_min(canonical, rank) AS first, arg_max(canonical, rank) AS last FROM k GROUP BY 1),
    z AS (SELECT *, max(number) OVER () AS most FROM g)
    SELECT number, CASE WHEN number = 1 THEN 'index.html' ELSE concat('index-', number, '.html') END AS page, n, first, last,
        CASE WHEN number = 2 THEN 'index.html' WHEN number > 2 THEN concat('index-', number - 1, '.html') END AS previous,
        CASE WHEN number < most THEN concat('index-', number + 1, '.html') END AS next FROM z""")
def pages_of_index(spark, sf_dir):
    """The index as pages of 50 records, and which pages they lead to."""
    scores = _scores(spark, sf_dir).withColumn("coverage", F.round("coverage", 9))
    return pages.index_pages(_records(spark, sf_dir), scores, 50).drop("html")


@query()
def pages_detail(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("source_url", F.lit(None).cast("string"))
    return pages.detail_pages(rows, records.summaries(rows), _scores(spark, sf_dir), _fused(spark, sf_dir, line=pages.chart_line()))


@query("SELECT concat('US-', p_partkey, '-B2') AS canonical, p_name AS title, p_type AS abstract, p_brand AS claim, '2020-01-07' AS pub_date FROM part")
def xml_bulk_parse(spark, sf_dir):
    """Every part as a grant in weekly files, written by the tasks and read back by the bulk reader."""
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    own = lambda c: T.escaped(F.col(c).cast("string"))
    number = tag("document-id", F.lit("<country>US</country>"), tag("doc-number", F.lpad(own("p_partkey"), 8, "0")), F.lit("<kind>B2</kind><date>20200107</date>"))
    claims = tag("claims", tag("claim", tag("claim-text", own("p_brand"))))
    grant = tag("us-patent-grant", tag("publication-reference", number), tag("invention-title", own("p_name")), tag("abstract", own("p_type")), claims)
    path = monitor.new_folder(spark, "grants")
    _table(spark, sf_dir, "part").select(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), grant)).toDF("value").write.text(f"{path}/weekly")
    found = readers.bulk_grants(spark, f"{path}/weekly", "*.txt")
    return found.select("canonical", "title", "abstract", F.get("claims", F.lit(0)).alias("claim"), "pub_date")


@query(JUDGED + " SELECT canonical, pos::INTEGER AS pos, round(CASE WHEN v1 = 'MISSING' THEN 0.0 ELSE greatest(0.0, least(1.0, c1)) END, 4)::DOUBLE AS strict, round(CASE WHEN v2 = 'MISSING' THEN 0.0 ELSE greatest(0.0, least(1.0, c2)) END, 4)::DOUBLE AS recall FROM j")
def channel_map(spark, sf_dir):
    rows = _fused(spark, sf_dir).select("canonical", "pos", judges.channels().alias("by"))
    return rows.select("canonical", "pos", *[F.round(F.col("by")[name], 4).alias(name) for name in judges.CHANNELS])


@query(_CELLS + " SELECT expected AS label, concat('| ', expected, ' | ', string_agg(n, ' | ' ORDER BY actual), ' |') AS line FROM cell GROUP BY 1")
def eval_matrix(spark, sf_dir):
    return markdown.matrix_rows(eval_confusion(spark, sf_dir))
