"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.sql import fold_marks

# The patterns of urls and addresses that template keys mask.
LOOSE_URL = r"(?i)(https?://\S+|www\.\S+|\b[\w-]+\.(?:com|net|org|ly|co|info|xyz|me|io)/\S*)"
EMAIL = r"[\w.+-]+\s*@\s*[\w-]+(\s*\.\s*[\w-]+)+"


def template_key(text: Column) -> Column:
    """TXT4: hash of the text with urls, addresses, digits and punctuation masked."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), LOOSE_URL, " <url> "), EMAIL, " <email> ")
    t = F.regexp_replace(F.regexp_replace(t, r"[0-9]+", "0"), r"[^\p{L}\p{N}_<>]+", " ")
    return F.substring(F.sha2(F.trim(t), 256), 1, 12)


# Lines of a text, their length, the shortest that is one, and where texts and records break.
MOST_LINES, MOST_CHARS, SHORTEST_LINE = 40, 200, 3
TEXT_BREAK, RECORD_BREAK = r"(?<=[.!?])\s+|\n+", r";\s*|\n+"


def clipped(text: Column, most: int = MOST_CHARS) -> Column:
    """White space folded; what is too long ends in an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def _numbered(rows: DataFrame, key: str, most: int) -> DataFrame:
    no = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("no", no).where(F.col("no") <= most).select(key, "no", "line")


def evidence_lines(df: DataFrame, key: str, text: str, most: int = MOST_LINES, chars: int = MOST_CHARS) -> DataFrame:
    """TXT1, WIN17: ``(key, no, line)``: the first lines and sentences of three characters or more, clipped, each once whatever its case."""
    parts = df.select(key, F.posexplode(F.split(text, TEXT_BREAK)).alias("pos", "part"))
    cut = parts.where(F.length(F.trim(F.regexp_replace("part", r"\s+", " "))) >= SHORTEST_LINE).select(key, "pos", clipped(F.col("part"), chars).alias("line"))
    first = cut.groupBy(key, F.lower("line").alias("_low")).agg(F.min(F.struct("pos", "line")).alias("x")).select(key, "x.pos", "x.line")
    return _numbered(first, key, most)


def record_lines(df: DataFrame, key: str, text: str, most: int = MOST_LINES, chars: int = MOST_CHARS) -> DataFrame:
    """TXT1: ``(key, no, line)``: the pieces of a record between semicolons and line ends, clipped; empty ones are none."""
    parts = df.select(key, F.posexplode(F.split(text, RECORD_BREAK)).alias("pos", "part"))
    return _numbered(parts.select(key, "pos", clipped(F.col("part"), chars).alias("line")).where("line <> ''"), key, most)


def canonical_message(text: Column) -> Column:
    """TXT5: urls that a tokeniser took apart put together again, addresses and source markers dropped, punctuation spaced outside
    urls, spaces folded."""
    t = F.regexp_replace(F.lower(text), r"(?m)^\s*(?:subject|re|fwd?)\s*:\s*", "")
    t = F.regexp_replace(t, r"(https?) ?: ?/ ?/ ?", "$1://")
    t = F.regexp_replace(t, EMAIL, " ")
    urls = F.regexp_extract_all(t, F.lit(r"https?://\S+"), F.lit(0))
    between = F.transform(F.split(t, r"https?://\S+"), lambda x: F.regexp_replace(x, "([,.;:!?])", " $1 "))
    whole = F.aggregate(
        F.sequence(F.lit(1), F.size(between)), F.lit(""), lambda s, i: F.concat(s, F.element_at(between, i), F.coalesce(F.get(urls, i - 1), F.lit("")))
    )
    return F.trim(F.regexp_replace(F.regexp_replace(whole, r"[ \t]+", " "), " ?\n ?", "\n"))


def token_estimate(text: Column) -> Column:
    """TXT11: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def grounded(quote: Column, line: Column) -> Column:
    """TXT9: the quote occurs in the line, spaces and case folded."""
    return F.coalesce((F.length(fold(quote)) > 0) & (F.instr(fold(line), fold(quote)) > 0), F.lit(False))


def span_locator(field: Column, text: Column, quote: Column) -> Column:
    """TXT10: ``field@start:end`` of a quote's first place; null where it has none."""
    at = F.instr(text, quote)
    return F.when((at > 0) & (F.length(quote) > 0), F.concat(field, F.lit("@"), at - 1, F.lit(":"), at - 1 + F.length(quote)))


def span_locator_at(field: Column, text: Column, quote: Column, n: Column) -> Column:
    """TXT10: ``field@start:end#n`` of a quote's n-th place, places not overlapping; null where it has fewer."""
    parts = F.split(text, F.concat(F.lit("\\Q"), quote, F.lit("\\E")))
    at = F.length(F.array_join(F.slice(parts, F.lit(1), n), "")) + (n - 1) * F.length(quote)
    ends = F.concat(field, F.lit("@"), at, F.lit(":"), at + F.length(quote), F.lit("#"), n)
    return F.when((F.length(quote) > 0) & (F.size(parts) > n), ends)


def resolve_span(locator: Column, text: Column) -> Column:
    """TXT10: the text a locator points to; null past the end or if malformed."""
    a = F.regexp_extract(locator, r"^[^@]+@([0-9]+):([0-9]+)$", 1)
    b = F.regexp_extract(locator, r"^[^@]+@([0-9]+):([0-9]+)$", 2)
    start, end = a.try_cast("int"), b.try_cast("int")
    return F.when((start < end) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def obfuscation(text: Column) -> dict[str, Column]:
    """TXT2: words that mix Latin with Cyrillic or Greek letters, and zero-width characters."""
    words = F.split(text, r"\s+")
    mixed = F.filter(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))
    return {"mixed_words": F.size(mixed).cast("long"), "zero_width": F.regexp_count(text, F.lit("[​‌‍⁠﻿]")).cast("long")}


def terms(df: DataFrame, key: str, text: str = "text", kinds: Sequence[str] | None = None) -> DataFrame:
    """TXT6: term counts per row: ``(key, term, n)`` of the words or, with ``kinds``, ``(key, kind, term, n)`` of words, bigrams of
    words and runs of four characters."""
    low = F.lower(F.col(text))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if kinds is None:
        return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    found = {
        "word": lambda: words,
        "bigram": lambda: _runs(words, 2),
        "char": lambda: F.transform(_starts(F.length(low), 4), lambda i: F.substring(low, i, F.lit(4))),
    }
    named = [F.transform(found[k](), _of_kind(k)) for k in kinds]
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(F.flatten(F.array(*named))).alias("x"))
    return rows.groupBy(key, "x.kind", "x.term").agg(F.count(F.lit(1)).alias("n"))


def _starts(length: Column, size: int) -> Column:
    """1 up to the last place where ``size`` items begin; none where there are fewer."""
    return F.when(length >= size, F.sequence(F.lit(1), length - size + 1)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, size: int) -> Column:
    return F.transform(_starts(F.size(words), size), lambda i: F.array_join(F.slice(words, i, size), " "))


def _marked(mark: str):
    return lambda t: F.concat(F.lit(mark), t)


def _of_kind(kind: str):
    return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))


def tag_trigrams(html: Column) -> Column:
    """TXT6: three tags in a row, in page order."""
    return _runs(F.transform(F.regexp_extract_all(html, F.lit(r"<\s*([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower), 3)


def tf_idf(counts: DataFrame, key: str) -> DataFrame:
    """TXT8: n * (ln((N + 1) / (df + 1)) + 1), L2-normalised per row."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = counts.select(key).distinct().count()
    w = counts.join(df, "term").withColumn("w", F.col("n") * (F.log(F.lit(total + 1.0) / (F.col("df") + 1)) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def semantic_words(text: Column) -> Column:
    """The words of a text, digits as 0."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit("[a-z0-9]+"), F.lit(0))


def semantic_terms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """TXT6: ``(key, term, n)`` of words, word bigrams and runs of four characters of the words, digits as 0."""
    t = df.where(F.col(text).isNotNull()).select(key, F.array_join(semantic_words(F.col(text)), " ").alias("_s"))
    return shingle_terms(t, [key], "_s")


def shingle_terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, term, n)`` of words, word bigrams and runs of four characters; ``text`` has words with one space between."""
    s, words = F.col(text), F.filter(F.split(text, " "), lambda w: w != "")
    four = F.transform(_starts(F.length(s), 4), lambda i: F.substring(s, i, F.lit(4)))
    named = [F.transform(x, _marked(k)) for k, x in (("w:", words), ("b:", _runs(words, 2)), ("c:", four))]
    return df.select(*keys, F.explode(F.flatten(F.array(*named))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def disguised(text: Column, words: Sequence[str]) -> Column:
    """TXT2: how many words are one of ``words`` once their diacritics are gone, and not before."""
    plain = lambda t: F.transform(F.split(t, r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    hits = lambda t: F.size(F.filter(plain(t), lambda w: w.isin(*words)))
    return (hits(fold_marks(text)) - hits(text)).cast("long")


def folder_date(name: Column) -> Column:
    """DAT1: the first eight digits in a row of a folder's name, as a date; null if they are none."""
    return F.try_to_date(F.regexp_extract(name, r"(?:^|\D)(\d{8})(?!\d)", 1), "yyyyMMdd")


def mail_date(header: Column) -> Column:
    """DAT1: the day, in UTC, of a mail header's date; null if it is none."""
    bare = F.regexp_extract(header, r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1)
    return F.to_date(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")))
