"""Text kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Claim words that don't tell elements apart.
STOPWORDS = (
    "a", "an", "the", "of", "to", "in", "for", "and", "or", "is", "are", "with", "by", "from", "at", "on", "that", "which",
    "said", "wherein", "comprising", "configured", "arranged", "having", "being", "method", "apparatus", "system", "device",
    "according", "claim", "further", "first", "second", "third", "one", "each", "between",
)
# Suffixes, in the order in which they are tried.
SUFFIXES = ("ies", "ing", "ed", "es", "s", "er", "ly", "tion", "ation")
CJK = r"[぀-ヿ一-鿿]"


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with more columns, each worked out once a row. They come from a generator of one row, so filters on what
    is made of them stay behind it and don't spell them out again wherever they name them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def met(rows: DataFrame) -> DataFrame:
    """``rows`` that are joined where they are dealt by the key. Spark guesses the size of what comes from a small
    compressed file by that of the file, and else sends millions of rows whole to the driver and every task."""
    return rows.hint("merge")


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """Distinct lower-case words, in order of first use, without stop words and single characters."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    keep = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    return F.array_distinct(keep)


def stem(t: Column) -> Column:
    """The word without its first fitting suffix, if three characters remain."""
    out = t
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(t, F.lit(s)) & (F.length(t) >= len(s) + 3), F.substring(t, 1, F.length(t) - len(s))).otherwise(out)
    return out


def sentences(x: Column) -> Column:
    """Trimmed non-empty sentences: lines, cut after full stops that white space follows."""
    lines = F.split(F.coalesce(x, F.lit("")), r"\R")
    parts = F.flatten(F.transform(lines, lambda line: F.split(strip(line), r"\.\s+")))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def claims(blob: Column) -> Column:
    """A blob of numbered claims, one text per claim; unnumbered text is one claim, blank text none."""
    parts = F.filter(F.transform(F.split(F.coalesce(blob, F.lit("")), r"(?m)^\s*(?=\d{1,3}\s*\.)"), strip), lambda p: p != "")
    return parts


def elements(claim: Column) -> Column:
    """Elements of a claim: what follows the first colon, cut at semicolons and connecting words."""
    text = F.regexp_replace(strip(F.coalesce(claim, F.lit(""))), r"^\s*\d+\s*\.\s*", "")
    body = F.regexp_replace(text, "^[^:]*:", "")  # names the text once, so it is worked out once
    parts = F.split(body, r"(?i);\s*|\b(?:wherein|comprising|configured to|arranged to)\b")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ,.;\n\t"))), lambda p: F.length(p) > 3)


def semantic_tokens(x: Column) -> Column:
    """Words of a-z and digits, two characters or more, and the bigrams of runs of kana and kanji, repeats kept."""
    low = F.lower(F.coalesce(x, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]{2,}"), 0)
    runs = F.regexp_extract_all(low, F.lit(CJK + "+"), 0)
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    return F.concat(words, F.flatten(pairs))


def squeezed(x: Column, most: int, keep: int | None = None) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis after ``keep`` of them."""
    one = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, keep or most - 1), F.lit("…"))).otherwise(one)


def cell(x: Column, most: int = 140) -> Column:
    """A Markdown table cell."""
    return F.replace(squeezed(F.coalesce(x, F.lit("")), most), F.lit("|"), F.lit("｜"))


def iso_date(ymd: Column) -> Column:
    """``yyyymmdd`` with dashes; null, blank and 0 are null, other text is passed on."""
    s = ymd.cast("string")
    dashed = F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))
    return F.when(s.isNull() | s.isin("", "0"), None).when(s.rlike("^[0-9]{8}$"), dashed).otherwise(s)


def localized(texts: Column, language: str = "en") -> Column:
    """Of ``array<struct<text, language>>`` the text in a language, else the first, else empty."""
    mine = F.filter(texts, lambda x: F.lower(x["language"]) == language)
    pick = F.when(F.size(mine) > 0, F.get(mine, F.lit(0))["text"]).otherwise(F.get(texts, F.lit(0))["text"])
    return F.coalesce(pick, F.lit(""))


def token_estimate(x: Column) -> Column:
    return F.floor(F.coalesce(F.regexp_count(x, F.lit(r"\S+")), F.lit(0)) * F.lit(1.3)).cast("bigint")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[/\\:]", "_")


def safe_link(url: Column) -> Column:
    """Only http and https links."""
    return F.when(F.lower(url).rlike("^https?://"), url)


def escaped(x: Column) -> Column:
    """Safe inside HTML text and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def specification_title(x: Column) -> Column:
    """The first line that isn't blank, without heading marks, cut to 80 characters."""
    first = F.get(F.filter(F.transform(F.split(x, r"\R"), strip), lambda s: s != ""), F.lit(0))
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(first, r"^#+", "")), 1, 80), F.lit("")), F.lit("(no title)"))


def reply_json(x: Column) -> Column:
    """The JSON object in a model's reply, as compact text: the reply without its code fence, else what stands between
    its outermost braces, else an empty object."""
    plain = strip(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    read = lambda s: F.to_json(F.try_parse_json(s))
    return F.coalesce(read(F.nullif(plain, F.lit(""))), read(F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))), F.lit("{}"))


def clamped_percent(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))


def content_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys and nulls kept."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
