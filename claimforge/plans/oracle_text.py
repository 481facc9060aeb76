"""Pieces of SQL for the other engine that several oracles share."""

from __future__ import annotations

from ..functions.text import STOPWORDS, SUFFIXES


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(x: str) -> str:
    stop = ", ".join(literal(w) for w in STOPWORDS)
    words = rf"string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+')"
    return f"list_sort(list_distinct(list_filter({words}, lambda w: length(w) > 1 AND w NOT IN ({stop}))))"


def stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) >= {len(s) + 3} THEN left({t}, length({t}) - {len(s)})" for s in SUFFIXES)
    return f"CASE {cases} ELSE {t} END"


def sentences(x: str) -> str:
    lines = rf"string_split_regex(coalesce({x}, ''), '\r\n|\n|\r')"
    parts = rf"flatten(list_transform({lines}, lambda l: string_split_regex(trim(l), '\.\s+')))"
    return f"list_filter(list_transform({parts}, lambda s: trim(s)), lambda s: s <> '')"


def elements(x: str) -> str:
    text = rf"regexp_replace(trim(coalesce({x}, '')), '^\s*\d+\s*\.\s*', '')"
    body = f"CASE WHEN strpos({text}, ':') > 0 THEN substr({text}, strpos({text}, ':') + 1) ELSE {text} END"
    parts = rf"string_split_regex({body}, '(?i);\s*|\bwherein\b|\bcomprising\b|\bconfigured to\b|\barranged to\b')"
    return f"list_filter(list_transform({parts}, lambda p: trim(p, ' ,.;')), lambda p: length(p) > 3)"


def judged(spec: str) -> str:
    """CTEs from v_records to ``j``: one row per element with tokens, both overlaps, and verdicts before and after the constraint."""
    return f"""
        spec AS (SELECT {tokens(literal(spec))} AS st, {sentences(literal(spec))} AS ss),
        stems AS (SELECT list_distinct(list_transform(st, lambda t: {stem('t')})) AS sm FROM spec),
        el AS (SELECT canonical, unnest(range(len(e))) AS pos, unnest(e) AS element FROM (SELECT canonical, {elements('claim')} AS e FROM v_records)),
        tk AS (SELECT canonical, pos, element, {tokens('element')} AS et FROM el),
        mt AS (SELECT tk.*, st, ss, list_sort(list_intersect(et, st)) AS m,
                 list_filter(et, lambda t: len(list_filter(sm, lambda s: s = ({stem('t')}) OR (length({stem('t')}) >= 4 AND length(s) >= 4
                   AND (contains(s, {stem('t')}) OR contains({stem('t')}, s))))) > 0) AS lm FROM tk, spec, stems),
        sh AS (SELECT *, len(et) AS n, len(m) AS k, len(lm) AS lk FROM mt),
        s1 AS (SELECT *, CASE WHEN n = 0 THEN 'UNCLEAR' WHEN k = 0 THEN 'MISSING' WHEN k / n >= 0.6 AND k >= 2 THEN 'MATCH' ELSE 'UNCLEAR' END AS v0,
                 CASE WHEN n = 0 THEN 0.0 WHEN k = 0 THEN 1.0 ELSE k / n END::DOUBLE AS c1,
                 CASE WHEN n = 0 THEN 'UNCLEAR' WHEN lk = 0 THEN 'MISSING' WHEN lk / n >= 0.4 THEN 'MATCH' ELSE 'UNCLEAR' END AS w0,
                 CASE WHEN n = 0 THEN 0.0 WHEN lk = 0 THEN 1.0 ELSE lk / n END::DOUBLE AS c2,
                 list_intersect(lm, st) AS sm2 FROM sh),
        s2 AS (SELECT *, CASE WHEN v0 <> 'MISSING' AND k > 0 THEN {best('m')} END AS sp1,
                 CASE WHEN w0 <> 'MISSING' AND len(sm2) > 0 THEN {best('sm2')} END AS sp2 FROM s1),
        j AS (SELECT *, CASE WHEN v0 = 'MATCH' AND (sp1 IS NULL OR c1 < 0.3) THEN 'UNCLEAR' ELSE v0 END AS v1,
                 CASE WHEN w0 = 'MATCH' AND (sp2 IS NULL OR c2 < 0.3) THEN 'UNCLEAR' ELSE w0 END AS v2 FROM s2),
        f0 AS (SELECT *, CASE WHEN v1 = 'MISSING' THEN 0.0 ELSE c1 END AS p1, CASE WHEN v2 = 'MISSING' THEN 0.0 ELSE c2 END AS p2 FROM j),
        f1 AS (SELECT *, (p1 + p2) / 2 AS p, 1 - (greatest(p1, p2) - least(p1, p2)) AS agreement, coalesce(sp1, sp2) AS span FROM f0),
        f2 AS (SELECT *, CASE WHEN p >= 0.6 THEN CASE WHEN span IS NULL THEN 'partial' ELSE 'covered' END WHEN p < 0.3 THEN 'gap' ELSE 'partial' END AS band FROM f1),
        f AS (SELECT *, (band = 'partial' OR agreement < 0.6) AS needs_review FROM f2),
        sc0 AS (SELECT canonical, count(*) AS ne, avg(p) AS mean, min(p) AS least, avg(agreement) AS agr, count(*) FILTER (p < 0.3) AS gaps, count(*) FILTER (needs_review) AS rev FROM f GROUP BY 1),
        sc AS (SELECT r.canonical, coalesce(ne, 0) AS n_elements, coalesce(100 * mean, 0.0) AS coverage,
                 coalesce(greatest(0.0, 100 * mean - least(25.0, 25 * (1 - agr) + least(gaps, ne) / ne * 5)), 0.0) AS low,
                 coalesce(least(100.0, 100 * mean + least(25.0, 25 * (1 - agr) + least(gaps, ne) / ne * 5)), 0.0) AS high,
                 coalesce(least, 0.0) AS least, coalesce(agr, 0.0) AS agreement, coalesce(gaps, 0) AS gap_count, coalesce(rev, 0) AS review_count,
                 CASE WHEN ne IS NULL THEN 'UNKNOWN' WHEN gaps = 0 AND mean >= 0.7 THEN 'HIGH' WHEN gaps <= 1 AND mean >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band
               FROM v_records r LEFT JOIN sc0 ON sc0.canonical = r.canonical)"""


def best(matched: str) -> str:
    """The sentence with most matched tokens, the first of equals."""
    scored = f"list_transform(ss, lambda s: len(list_intersect({tokens('s')}, {matched})))"
    return f"left(ss[list_position({scored}, list_max({scored}))], 200)"


def effect() -> str:
    text = "upper(concat_ws(' ', code, description))"
    return rf"""CASE WHEN regexp_matches({text}, 'REINSTAT|RESTOR|RE-ESTABLISH') THEN 'UNKNOWN' WHEN regexp_matches({text}, '\bEXPIR') THEN 'EXPIRED'
        WHEN regexp_matches({text}, '\bLAPSE') THEN 'LAPSED' WHEN regexp_matches({text}, 'NON[- ]?PAYMENT') THEN 'LAPSED' WHEN regexp_matches({text}, '\bREVOK') THEN 'REVOKED'
        WHEN regexp_matches({text}, '\bWITHDRAW') THEN 'LAPSED' END"""


def semantic_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{2,}}')"


def hashed_counts(texts: str, dimensions: int) -> str:
    """``id, bucket, c``: words of each text, dealt to buckets by the first 16 bits of their MD5, and counted."""
    words = f"SELECT id, unnest({semantic_tokens('text')}) AS term FROM ({texts})"
    return f"SELECT id, (('0x' || left(md5(term), 4))::BIGINT % {dimensions}) AS bucket, count(*) AS c FROM ({words}) GROUP BY 1, 2"


def tfidf(query: str) -> str:
    """CTEs over documents to ``w`` (id, term, weight), ``qw`` (term, weight) and ``sem`` (id, semantic)."""
    return f"""
        tk AS (SELECT doc_id AS id, unnest({semantic_tokens('text')}) AS term FROM documents),
        tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY 1, 2),
        qt AS (SELECT term, count(*) AS tf FROM (SELECT unnest({semantic_tokens(literal(query))}) AS term) GROUP BY 1),
        df AS (SELECT term, count(*) AS df FROM (SELECT term FROM tf UNION ALL SELECT term FROM qt) GROUP BY 1),
        idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 2.0) / (df + 1)) + 1 AS idf FROM df),
        w0 AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
        nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY 1),
        w AS (SELECT id, term, w / norm AS weight FROM w0 JOIN nm USING (id)),
        q0 AS (SELECT term, tf * idf AS w FROM qt JOIN idf USING (term)),
        qw AS (SELECT term, w / (SELECT sqrt(sum(w * w)) FROM q0) AS weight FROM q0),
        dot AS (SELECT id, sum(w.weight * qw.weight) AS dot FROM w JOIN qw USING (term) GROUP BY 1),
        sem AS (SELECT doc_id AS id, greatest(0.0, coalesce(dot, 0.0)) AS semantic FROM documents LEFT JOIN dot ON dot.id = doc_id)"""
