"""Which pairs of a posting table to compare: hubs first, then an exact completion of what they leave apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, free
from .skew import salted_join

#: Hubs of a token in the second round; how much larger the next bucket of set sizes is.
HUBS, STEP = 4, 1.1


def linked(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    may_link: Callable[[Column, Column], Column] | None = None,
    hubs: int = HUBS,
) -> tuple[DataFrame, DataFrame | None]:
    """Links from ``token, rep, core, about``, and ``rep, component`` of the reps that still share a token with a rep of
    another component that they haven't been compared with (null if there is none).

    Two reps are candidates when they share a token and ``may_link`` of their ``about`` holds; ``verify`` keeps the pairs
    ``a, b`` that link. First, a rep tries one hub: of the members of highest ``core`` of its tokens, the one that heads
    most of them. Then all members of a token try its members of highest ``core`` among each of ``hubs`` parts, unless
    they are linked by then. Those hubs leave the token, and nothing is lost by that: the pairs of both rounds are at
    most ``hubs + 1`` times the postings.
    """
    best = lambda *more: F.min_by(F.struct("rep", "about", *more), F.struct(-F.col("core"), F.col("rep"))).alias("head")
    heads = cut(postings.groupBy("token").agg(best(), F.count(F.lit(1)).alias("n")).filter("n > 1"), "partners-heads")
    tries = salted_join(postings, heads.select("token", "head"), ["token"], heads)
    votes = _apart(tries, may_link).groupBy("a", "b").count()
    first = votes.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    first = cut(first, "partners-pairs")
    links = cut(verify(first), "partners-links")

    rows = cut(postings.join(_labels(links), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "partners-rows")
    part = F.pmod(F.xxhash64(F.lit("hub"), "rep"), F.lit(hubs)).alias("part")
    heads = rows.groupBy("token", part).agg(best("component"), F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = heads.groupBy("token").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    heads = cut(heads.select("token", "head").join(sizes.select("token", "n"), "token"), "partners-heads")
    counts = heads.groupBy("token").agg(F.first("n").alias("n"))
    tries = salted_join(rows, heads.select("token", "head"), ["token"], counts).filter("component != head.component")
    second = _apart(tries, may_link).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = cut(second.join(done, ["a", "b"], "left_anti"), "partners-pairs")
    links = cut(links.unionByName(verify(second)), "partners-links")

    rest = rows.join(counts.select("token"), "token", "left_semi").join(heads.select("token", F.col("head.rep").alias("rep")), ["token", "rep"], "left_anti")
    rest = rest.drop("component").join(_labels(links), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = cut(rest.select("token", "rep", "component"), "partners-rest")
    free(rows)
    sizes = rest.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    left = cut(rest.join(sizes.select("token"), "token", "left_semi").select("rep", "component").distinct(), "partners-left")
    return links, None if left.isEmpty() else left


def _apart(tries: DataFrame, may_link: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Pairs ``a`` (the rep) and ``b`` (its hub)."""
    tries = tries.filter(F.col("rep") != F.col("head.rep"))
    tries = tries if may_link is None else tries.filter(may_link(F.col("about"), F.col("head.about")))
    return tries.select(F.col("rep").alias("a"), F.col("head.rep").alias("b"))


def _labels(links: DataFrame) -> DataFrame:
    """``rep, component`` of linked reps: the smallest rep within two links, which makes one of each star. Where reps of
    one component get different labels they are only compared once more."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    far = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("low").alias("low"))
    return far.select(F.col("a").alias("rep"), F.least("a", "low").alias("component"))


def ordered(spread: DataFrame, percent: int) -> DataFrame:
    """``rep, n, component, token, df, place, core`` from ``rep, n, component, token``, the distinct tokens of each set:
    its place in the global order, by document frequency and then token, for tokens that two sets have at least. Sets
    without enough such tokens for a link are left out; ``core`` is high where a set's tokens are common."""
    counts = cut(spread.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "order-counts")
    rows = salted_join(spread, counts.select("token", F.col("n").alias("df")), ["token"], counts)
    rows = rows.select("rep", "n", "component", "token", "df")
    whole = Window.partitionBy("rep")
    rows = rows.withColumn("m", F.count(F.lit(1)).over(whole)).withColumn("core", F.sum("df").over(whole) / F.col("n"))
    rows = rows.filter(100 * F.col("m") >= percent * F.col("n"))
    place = F.row_number().over(whole.orderBy("df", "token")) + F.col("n") - F.col("m")
    return rows.withColumn("place", place).drop("m")


def prefixes(places: DataFrame, percent: int) -> DataFrame:
    """The tokens among the first ``n - ceil(percent n / 100) + 1`` of each set: two sets that link share one of them."""
    last = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return places.filter(F.col("place") <= last).withColumn("rest", F.col("n") - F.col("place") + 1)


def completion(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs ``a, b`` that may link across components, from ``token, rep, component, n, rest``.

    ``rest`` is what a set has from the token on in the order. If the token is the first that two sets share, they have
    ``least(rest, rest)`` tokens in common at most, so a row asks only for partners of the sizes that leave room for a
    link: a set that differs from all others in a tenth of its own asks for none of them. Of each token's rows those of
    its largest component don't ask, so a group of near copies, once joined, never meets itself.
    """
    p = percent / 100.0
    sizes = prefix.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    tokens = sizes.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    tokens = cut(tokens.filter("parts > 1"), "completion-tokens")
    rows = cut(salted_join(prefix.select("token", "rep", "component", F.col("n").alias("size"), "rest"), tokens.select("token", "main"), ["token"], tokens), "completion-rows")
    bucket = lambda size: F.floor(F.log(size) / F.log(F.lit(STEP))).cast("int")
    least = F.col("size") * p
    most = F.least(F.col("size") / p, F.col("rest") * (1 + p) / p - F.col("size"))
    asks = rows.filter("component != main").withColumn("low", bucket(least - 1e-6)).withColumn("high", bucket(most + 1e-6))
    asks = asks.filter(F.col("low") <= F.col("high")).withColumn("bucket", F.explode(F.sequence("low", "high")))
    asks = asks.select("token", "bucket", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("size").alias("na"), F.col("rest").alias("ra"))
    told = rows.select("token", bucket(F.col("size") + 0.0).alias("bucket"), F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("size").alias("nb"), F.col("rest").alias("rb"))
    met = salted_join(told, asks, ["token", "bucket"]).filter(F.col("ca") != F.col("cb"))
    met = met.filter((100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
