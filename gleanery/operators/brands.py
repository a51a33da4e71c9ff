"""Brand joins: names in page text, names in urls, and look-alikes one edit away, all by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deletions(word: Column) -> Column:
    """The word and all words that one deletion makes of it."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    )
    return F.array_distinct(F.array_append(cut, word))


def swapped(a: Column, b: Column) -> Column:
    """Whether one swap of neighbouring characters turns ``a`` into ``b``."""
    turned = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))),
    )
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.array_contains(turned, b)


def look_alikes(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """JOIN13: pairs of words at a Damerau-Levenshtein distance of exactly one. Words within one edit share a word of their
    deletion neighbourhoods, which is the join key; the pairs that meet there are then checked."""
    x = left.select(a).distinct().withColumn("_k", F.explode(deletions(F.col(a))))
    y = right.select(b).distinct().withColumn("_k", F.explode(deletions(F.col(b))))
    met = x.join(y, "_k").where(F.col(a) != F.col(b)).select(a, b).distinct()
    return met.where((F.levenshtein(F.col(a), F.col(b)) == 1) | swapped(F.col(a), F.col(b)))


def named_elsewhere(pages: DataFrame, tokens: str, own: str, brands: DataFrame) -> DataFrame:
    """JOIN12: url tokens that are a brand's word on a page that is none of the brand's domains."""
    said = pages.withColumn("word", F.explode(tokens)).join(brands, "word")
    return said.where(~F.array_contains("domains", F.col(own))).drop("domains")


def named_in_text(texts: DataFrame, text: str, brands: DataFrame) -> DataFrame:
    """JOIN11: brands whose one-word name stands as a word in the text: an equi-join on its words."""
    words = F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")))
    return texts.withColumn("word", words).join(brands.select("word", "domains"), "word")


# The shortest name that is no acronym, the places that count for a strict look-up, names and domains that are told.
SHORTEST, STRICT_PLACES, MOST_NAMES, MOST_DOMAINS = 4, ("title", "h1", "h2", "form"), 3, 5
#: A run of ASCII letters and digits, or one character of another script.
TOKEN = r"[A-Za-z0-9]+|[^\x00-\x7F]"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def name_patterns(brands: DataFrame, strict: bool = False) -> DataFrame:
    """``(brand, domains, tokens, exact)``: names that can be looked for, as tokens, and whether by case. A name of fewer than four
    characters must be an acronym in capitals, and is looked for as written; so is every name of a strict look-up, which
    leaves out names in small letters. A name without a letter or digit of any script has no tokens and is left out."""
    name = F.trim("brand")
    acronym = (F.upper(name) == name) & (F.lower(name) != name) & name.rlike(r"^\p{L}+$")
    usable = (F.length(name) >= SHORTEST) | acronym
    if strict:
        usable = usable & (F.lower(name) != name)
    rows = brands.where(usable).select("brand", "domains", _tokens(name).alias("tokens"), (F.lit(strict) | (F.length(name) < SHORTEST)).alias("exact"))
    return rows.where(F.size("tokens") > 0)


def mentions(texts: DataFrame, key: str, brands: DataFrame, strict: bool = False) -> DataFrame:
    """JOIN11: ``(key, brand, domains, places)``: names of one or more words that stand in the texts ``(key, place, text)`` of a page, with
    no ASCII letter or digit on either side, and where.

    A name meets a text by its first token; the tokens from there must be the name's, and then the text must hold the name as it is
    written, marks included. So pairs are formed only where a name's first word stands."""
    names = name_patterns(brands, strict)
    rows = texts.where(F.col("place").isin(*STRICT_PLACES)) if strict else texts
    t = rows.select(key, "place", "text", _tokens(F.col("text")).alias("_said")).distinct()
    at = t.select(key, "place", "text", "_said", F.posexplode("_said").alias("_at", "_first"))
    met = at.join(names.withColumn("_first", F.col("tokens")[0]), "_first").where(F.slice("_said", F.col("_at") + 1, F.size("tokens")) == F.col("tokens"))
    pattern = F.concat(F.when(F.col("exact"), "").otherwise("(?i)"), F.lit(r"(?<![A-Za-z0-9])\Q"), F.trim("brand"), F.lit(r"\E(?![A-Za-z0-9])"))
    held = met.where(F.rlike("text", pattern))
    return held.groupBy(key, "brand").agg(F.first("domains").alias("domains"), F.array_sort(F.collect_set("place")).alias("places"))


def lookup(texts: DataFrame, key: str, brands: DataFrame, pages: DataFrame, links: DataFrame, strict: bool = False) -> DataFrame:
    """JOIN11: a row for each of the three names of a page that stand in most places (then by name): ``places``, the first five ``official``
    domains, whether the page's ``own`` is one, how many of its links lead to one, of how many, and whether it has a password field.
    ``pages``: ``(key, own, password)``; ``links``: ``(key, to)``, ``to`` a registrable name, null for a link that stays. A strict look-up
    judges pages with a password field only."""
    judged = pages.where("password") if strict else pages
    said = mentions(texts.join(judged.select(key), key, "left_semi"), key, brands, strict)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.size("places").desc(), "brand"))
    said = said.withColumn("place_no", rank).where(F.col("place_no") <= MOST_NAMES)
    out = said.join(judged.select(key, "own", "password"), key)
    anchors = links.groupBy(key).agg(F.count(F.lit(1)).alias("anchors"))
    to = said.select(key, "brand", F.explode(F.array_distinct("domains")).alias("to")).join(links.where("to is not null"), [key, "to"])
    to = to.groupBy(key, "brand").agg(F.count(F.lit(1)).alias("to_brand"))
    out = out.join(anchors, key, "left").join(to, [key, "brand"], "left").fillna(0, ["anchors", "to_brand"])
    official = F.slice(F.array_sort("domains"), 1, MOST_DOMAINS)
    return out.select(key, "place_no", "brand", "places", official.alias("official"), "own", F.array_contains("domains", F.col("own")).alias("is_own"), "to_brand", "anchors", "password")
