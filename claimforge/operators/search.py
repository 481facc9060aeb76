"""Prior-art search: predicates of a brief, keyword rank, families, TF-IDF and their fusion, watched searches."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.folders import new_folder
from ..functions.text import met, semantic_tokens

# Points for a title hit, an abstract hit and a class hit; a gap between channels that asks for review.
TITLE, ABSTRACT, CLASS, APART = 3, 1, 2, 0.5


@dataclass
class Brief:
    """A search brief."""

    name: str = ""
    purpose: str = ""
    report_type: str = ""
    description: str = ""
    keywords: tuple[tuple[str, ...], ...] = ()
    cpc: tuple[str, ...] = ()
    assignees: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    limit: int = 200
    search_claims: bool = False

    def __post_init__(self) -> None:
        if not (self.keywords or self.cpc or self.assignees):
            raise ValueError("a brief needs keywords, classes or assignees")
        if any(not k.strip() for group in self.keywords for k in group) or any(not group for group in self.keywords):
            raise ValueError("blank keyword")
        if not 1 <= self.limit <= 5000:
            raise ValueError("limit must be 1 to 5000")
        for d in (self.date_from, self.date_to):
            if d and (len(digits := d.replace("-", "")) != 8 or not digits.isdigit()):
                raise ValueError(f"not a date: {d}")

    @classmethod
    def load(cls, text: str) -> Brief:
        found = {k: v for k, v in json.loads(text).items() if v is not None}
        if unknown := sorted(set(found) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown keys: {', '.join(unknown)}")
        for k in ("keywords", "cpc", "assignees", "countries"):
            if k in found:
                found[k] = tuple(tuple(v) if k == "keywords" else v for v in found[k])
        return cls(**found)

    @property
    def query_text(self) -> str:
        return self.description or " ".join(k for group in self.keywords for k in group) or self.purpose


def _says(texts: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(texts, lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(x["text"], F.lit(""))), F.lit(t.strip().lower())) for t in terms]))


def _day(d: str) -> int:
    return int(d.replace("-", ""))


def predicate(brief: Brief) -> Column:
    """The brief as one filter: scalar conditions first, which reach the scan, then those on nested texts."""
    out = F.lit(True)
    if brief.countries:
        out = out & F.col("country_code").isin(*[c.upper() for c in brief.countries])
    if brief.date_from:
        out = out & (F.col("publication_date") >= _day(brief.date_from))
    if brief.date_to:
        out = out & (F.col("publication_date") <= _day(brief.date_to))
    for group in brief.keywords:
        places = ["title_localized", "abstract_localized"] + ["claims_localized"] * brief.search_claims
        out = out & reduce(lambda a, b: a | b, [_says(F.col(c), group) for c in places])
    if brief.cpc:
        out = out & F.exists("cpc", lambda c: reduce(lambda a, b: a | b, [F.startswith(c["code"], F.lit(p.upper())) for p in brief.cpc]))
    if brief.assignees:
        out = out & F.exists("assignee_harmonized", lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x["name"]), F.lit(n.strip().lower())) for n in brief.assignees]))
    return out


def search(rows: DataFrame, brief: Brief) -> DataFrame:
    """Rows that the brief asks for, in the order of their numbers, as many as its limit."""
    return rows.filter(predicate(brief)).orderBy("publication_number").limit(brief.limit)


class SearchSql(NamedTuple):
    """A brief as SQL over a table ``{rows}``, its values as named parameters: nothing of a brief is ever spelled into the
    text, so quotes and patterns in it mean themselves."""

    sql: str
    args: dict[str, str | int]

    def logged(self) -> str:
        """The text for a search log: the SQL, and after it the parameters as JSON on a line of their own."""
        return f"{self.sql}\n-- {json.dumps(self.args, ensure_ascii=False, sort_keys=True)}"

    @classmethod
    def from_log(cls, text: str) -> SearchSql:
        sql, _, args = text.rpartition("\n-- ")
        return cls(sql, json.loads(args))

    def run(self, rows: DataFrame) -> DataFrame:
        return rows.sparkSession.sql(self.sql, args=self.args, rows=rows)


def search_sql(brief: Brief, columns: tuple[str, ...] = ("*",)) -> SearchSql:
    """What ``search`` does, as SQL with named parameters; ``columns`` are those of the result."""
    args: dict[str, str | int] = {}

    def value(name: str, v: str | int) -> str:
        args[name] = v
        return f":{name}"

    def any_of(column: str, condition: str, name: str, values: list[str]) -> str:
        told = " OR ".join(condition.format(value(f"{name}_{i}", v)) for i, v in enumerate(values))
        return f"exists({column}, x -> {told})"

    where = []
    if brief.countries:
        where.append(f"country_code IN ({', '.join(value(f'country_{i}', c.upper()) for i, c in enumerate(brief.countries))})")
    if brief.date_from:
        where.append(f"publication_date >= {value('date_from', _day(brief.date_from))}")
    if brief.date_to:
        where.append(f"publication_date <= {value('date_to', _day(brief.date_to))}")
    for g, group in enumerate(brief.keywords):
        places = ["title_localized", "abstract_localized"] + ["claims_localized"] * brief.search_claims
        terms = [t.strip().lower() for t in group]
        where.append("(" + "\n    OR ".join(any_of(c, "contains(lower(coalesce(x.text, '')), {})", f"term_{g}", terms) for c in places) + ")")
    if brief.cpc:
        where.append(any_of("cpc", "startswith(x.code, {})", "class", [p.upper() for p in brief.cpc]))
    if brief.assignees:
        where.append(any_of("assignee_harmonized", "contains(lower(x.name), {})", "assignee", [n.strip().lower() for n in brief.assignees]))
    conditions = "\n  AND ".join(where)
    sql = f"SELECT {', '.join(columns)}\nFROM {{rows}}\nWHERE {conditions}\nORDER BY publication_number\nLIMIT {value('most', brief.limit)}"
    return SearchSql(sql, args)


def rank(rows: DataFrame, brief: Brief) -> DataFrame:
    """Score of every row: per keyword group a title or else an abstract hit, per class prefix a hit."""
    title, abstract = F.col("title_localized"), F.col("abstract_localized")
    in_title = [_says(title, g) for g in brief.keywords]
    in_abstract = [_says(abstract, g) for g in brief.keywords]
    hits = [(t | a).cast("int") for t, a in zip(in_title, in_abstract, strict=True)]
    points = [F.when(t, TITLE).when(a, ABSTRACT).otherwise(0) for t, a in zip(in_title, in_abstract, strict=True)]
    points += [_class_points(p) for p in brief.cpc]
    total = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))
    return rows.filter("publication_number IS NOT NULL").select(
        "publication_number",
        F.nullif(F.col("family_id").cast("string"), F.lit("")).alias("family_id"),
        total(points).cast("bigint").alias("score"),
        total(hits).cast("bigint").alias("groups_hit"),
        F.lit(len(brief.keywords)).cast("bigint").alias("groups_total"),
        (total(hits) < len(brief.keywords)).alias("needs_review"),
    )


def _class_points(prefix: str) -> Column:
    return F.when(F.exists("cpc", lambda c: F.startswith(F.upper(c["code"]), F.lit(prefix.upper()))), CLASS).otherwise(0)


def snippet(text: Column, term: str, around: int = 60) -> Column:
    """The words around the first hit of a term, as they stand."""
    at = F.locate(term.lower(), F.lower(text))
    return F.when(at > 0, F.trim(F.substring(text, F.greatest(F.lit(1), at - around), F.least(at - 1, F.lit(around)) + len(term) + around)))


def _first_hit(texts: Column, terms: tuple[str, ...]) -> Column:
    """``struct<term, said>`` of the first term that the first text with any of them has; null without one."""
    known = [t for t in terms if t.strip()]
    hits = lambda x: F.array(*[F.when(F.contains(F.lower(x["text"]), F.lit(t.strip().lower())), F.struct(F.lit(t).alias("term"), snippet(x["text"], t.strip()).alias("said"))) for t in known])
    if not known:
        return F.lit(None).cast("struct<term:string,said:string>")
    return F.get(F.filter(F.flatten(F.transform(texts, hits)), lambda h: h.isNotNull()), F.lit(0))


def explained(rows: DataFrame, brief: Brief) -> DataFrame:
    """``rank`` with ``matched_terms``, ``evidence`` and ``notes``: the term and the words around it that each keyword
    group scored by, the first class of each prefix, evidence that backs two of them once, and what to verify."""
    title, abstract = F.col("title_localized"), F.col("abstract_localized")
    found = [(_first_hit(title, g), _first_hit(abstract, g)) for g in brief.keywords]
    named = rows.filter("publication_number IS NOT NULL").select("publication_number", F.struct(*[F.struct(t.alias("title"), a.alias("abstract")).alias(f"g{i}") for i, (t, a) in enumerate(found)], F.lit(0).alias("_")).alias("_f"), "cpc")
    groups = [F.col(f"_f.g{i}") for i in range(len(found))]
    quoted = lambda where, said: F.concat(F.lit(f"{where}: “"), said, F.lit("”"))
    terms = [F.coalesce(g["title"]["term"], g["abstract"]["term"]) for g in groups]
    said = [F.when(g["title"].isNotNull(), quoted("title", g["title"]["said"])).when(g["abstract"].isNotNull(), quoted("abstract", g["abstract"]["said"])) for g in groups]
    for prefix in brief.cpc:
        codes = F.transform(F.filter("cpc", lambda c: F.startswith(F.upper(c["code"]), F.lit(prefix.upper()))), lambda c: c["code"])  # noqa: B023
        said.append(F.concat(F.lit("cpc: "), F.array_min(codes)))
    texts = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    hits = F.size(texts(terms))
    note = F.when(hits < len(groups), F.concat(hits.cast("string"), F.lit(f" of {len(groups)} keyword groups stand in title or abstract; the others may stand in claims only: verify before triage")))
    more = named.select("publication_number", texts(terms).alias("matched_terms"), F.array_distinct(texts(said)).alias("evidence"), texts([note]).alias("notes"))
    return rank(rows, brief).join(more.dropDuplicates(["publication_number"]), "publication_number")


def one_per_family(ranked: DataFrame) -> DataFrame:
    """The best member of each family, by score and then number, both from the highest, with its siblings; rows without
    a family stay as they are."""
    best = Window.partitionBy("family_id").orderBy(F.desc("score"), F.desc("publication_number"))
    whole = Window.partitionBy("family_id")
    own = ranked.filter("family_id IS NOT NULL").withColumn("_k", F.row_number().over(best))
    own = own.withColumn("siblings", F.array_sort(F.array_remove(F.collect_list("publication_number").over(whole), F.col("publication_number"))))
    alone = ranked.filter("family_id IS NULL").withColumn("siblings", F.array().cast("array<string>"))
    return own.filter("_k = 1").drop("_k").unionByName(alone)


def _term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf`` of all documents, written once, as texts cost far more to take apart than to be read again.

    Texts are dealt by document before that, so their terms are counted where they are and only texts are shuffled.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    counts = texts.select("id", F.explode(semantic_tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    path = new_folder(spark, "terms")
    counts.write.parquet(path)
    return spark.read.schema(counts.schema).parquet(path)


def _weighed(docs: DataFrame, query: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, term, w`` of all documents, not yet normalised, and ``term, weight`` of the query, which counts as one of them."""
    asked = docs.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(semantic_tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    tf = _term_counts(docs, id_col, text_col)
    n = docs.agg((F.count(F.lit(1)) + 1).alias("n"))  # one row
    df = tf.select("term").unionAll(asked.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = tf.join(met(idf), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    own = asked.join(idf, "term").select("term", (F.col("tf") * F.col("idf")).alias("w"))
    total = own.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted, own.crossJoin(F.broadcast(total)).select("term", (F.col("w") / F.col("norm")).alias("weight"))


def _norm(over: WindowSpec | None = None) -> Column:
    """The length of the weights of a group, 1 for none."""
    total = F.sum(F.col("w") * F.col("w"))
    return F.coalesce(F.nullif(F.sqrt(total.over(over) if over else total), F.lit(0.0)), F.lit(1.0))


def tfidf(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Normalised weights ``id, term, weight`` of all documents, and of the query, which counts as one of them."""
    weighted, asked = _weighed(docs, query, id_col, text_col)
    norm = _norm(Window.partitionBy("id"))  # the terms of a document
    return weighted.filter("id IS NOT NULL").select("id", "term", (F.col("w") / norm).alias("weight")), asked


def similarity(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, semantic``: cosine of every document with the query, 0 without common terms.

    One aggregate gives each document's norm and its product with the query; no table of normalised weights is made.
    """
    weighted, asked = _weighed(docs, query, id_col, text_col)
    rows = weighted.join(F.broadcast(asked.withColumnRenamed("weight", "q")), "term", "left")  # the query's terms
    dots = rows.groupBy("id").agg((F.sum(F.col("w") * F.coalesce("q", F.lit(0.0))) / _norm()).alias("dot"))
    return docs.select(F.col(id_col).alias("id")).join(dots, "id", "left").select("id", F.greatest(F.lit(0.0), F.coalesce("dot", F.lit(0.0))).alias("semantic"))


def fused(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """``id, score, semantic, combined, needs_review``: both channels over their largest value, and their mean."""
    rows = keyword.join(semantic, "id")
    most = rows.agg(F.coalesce(F.nullif(F.max("score"), F.lit(0)), F.lit(1)).alias("ms"), F.coalesce(F.nullif(F.max("semantic"), F.lit(0.0)), F.lit(1.0)).alias("mt"))
    rows = rows.crossJoin(F.broadcast(most)).select("id", "score", "semantic", (F.col("score") / F.col("ms")).alias("k"), (F.col("semantic") / F.col("mt")).alias("s"))
    return rows.select("id", "score", "semantic", ((F.col("k") + F.col("s")) / 2).alias("combined"), (F.abs(F.col("k") - F.col("s")) > APART).alias("needs_review"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 at least; a zero vector has norm 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(0.0), dot(a, b) / (norm(a) * norm(b)))


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the places of the vectors that have it and these as a matrix; those that are null or hold a null are in
    none."""
    lists = column.combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values
    gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (gaps[ends[1:]] == gaps[ends[:-1]])
    numbers, sizes = values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends)
    places = {int(n): np.flatnonzero(whole & (sizes == n)) for n in np.unique(sizes[whole])}
    return {n: (at, numbers[ends[:-1][at][:, None] + np.arange(n)]) for n, at in places.items()}


def _block_cosines(left: pa.Table, right: pa.Table) -> np.ndarray:
    """``dense_cosine`` of every vector of one block with every one of another, as a matrix product."""
    out = np.zeros((left.num_rows, right.num_rows))
    if not out.size:
        return out
    mine, theirs = _vectors(left["embedding"]), _vectors(right["q"])

    def norm(m: np.ndarray) -> np.ndarray:
        n = np.sqrt((m * m).sum(axis=1))
        return np.where(n == 0, 1.0, n)

    with np.errstate(all="ignore"):
        for n in mine.keys() & theirs.keys():
            (at, a), (to, b) = mine[n], theirs[n]
            out[np.ix_(at, to)] = np.maximum(0.0, (a @ b.T) / np.outer(norm(a), norm(b)))
    return out


def cosines(rows: DataFrame, asked: DataFrame, block: int = 512, most: int = 2048) -> DataFrame:
    """``vec_id, query_id, cosine`` of every row (``vec_id, embedding``) with every query (``query_id, q``), each cosine as
    ``dense_cosine`` has it.

    Rows are dealt to blocks of about ``most`` and queries to blocks of about ``block``, and every two blocks meet in a
    task as one matrix product: what a task holds is bounded, whatever there is of either.
    """
    ids = {f.name: f.dataType for f in (rows.schema["vec_id"], asked.schema["query_id"])}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _block_cosines(left, right)
        mine = left["vec_id"].combine_chunks().take(pa.array(np.repeat(np.arange(left.num_rows), right.num_rows)))
        theirs = right["query_id"].combine_chunks().take(pa.array(np.tile(np.arange(right.num_rows), left.num_rows)))
        return pa.table({"vec_id": mine, "query_id": theirs, "cosine": found.ravel()})

    blocks = lambda df, size, name: df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias(name))
    sizes = F.broadcast(blocks(rows, most, "_n").crossJoin(blocks(asked, block, "_m")))  # one row
    dealt = lambda n: F.floor(F.rand(0) * F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select("vec_id", "embedding").crossJoin(sizes).withColumn("_r", dealt("_n")).withColumn("_b", each("_m")).drop("_n", "_m")
    right = asked.select("query_id", "q").crossJoin(sizes).withColumn("_b", dealt("_m")).withColumn("_r", each("_n")).drop("_n", "_m")
    return left.groupBy("_r", "_b").cogroup(right.groupBy("_r", "_b")).applyInArrow(meet, StructType([*[StructField(k, t) for k, t in ids.items()], StructField("cosine", DoubleType())]))


def split_seen(hits: DataFrame, seen: DataFrame, key: tuple[str, ...] = ("theme", "pub")) -> tuple[DataFrame, DataFrame]:
    """New hits, and those seen before."""
    known = seen.select(*key)
    return hits.join(known, list(key), "left_anti"), hits.join(known, list(key), "left_semi")


def absorb(seen: DataFrame, hits: DataFrame) -> DataFrame:
    """``theme, pub, first_seen`` with the hits of a run; the first date stays."""
    every = seen.select("theme", "pub", "first_seen").unionByName(hits.select("theme", "pub", F.col("run_date").alias("first_seen")))
    return every.groupBy("theme", "pub").agg(F.min("first_seen").alias("first_seen"))
