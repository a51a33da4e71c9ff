"""Quality rules with host verdicts: base rules per document, failure rates per host shrunk by an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.texts import blocks
from gleanery.sources.shared import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur at least twice in the list."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = reach = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def text_facts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and words in repeated windows; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FACTS.split(", ")]
    for b in blocks(batches, 4 << 20):
        found = list(zip(*(text_facts(t.as_py()) for t in b.column("text"))))
        cols = {"doc_id": b.column("doc_id"), "host": b.column("host")}
        yield pa.RecordBatch.from_pydict(cols | {n: pa.array(c, pa.int64()) for n, c in zip(names, found)})


def document_facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, ``host`` and the counts of :func:`text_facts`, one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_facts, f"doc_id {kind}, host string, {FACTS}")


def host_rates(facts: DataFrame, failed: str = "base_failed") -> DataFrame:
    """``(host, n_docs, n_failed, rate)``: each host's failure rate shrunk by a beta prior fitted to all hosts' rates.

    The prior's mean and variance are those of the raw rates over hosts (moments). Where the rates don't vary, or vary
    more than any beta would, the prior weighs one document.
    """
    hosts = facts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(raw), F.var_pop(raw)).first()
    m = m or 0.0
    weight = max(1.0, m * (1 - m) / v - 1) if v else 1.0
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight)))


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5, least_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Base rules per document, and the verdict of its host: ``kept`` unless the document fails the base rules or its
    host's shrunk failure rate is above ``max_rate``.

    One row per row of ``docs``. Null and empty texts have no words and so fail; rows with a null host share one; repeated
    rows and a null ``doc_id`` are rows like others; an empty table gives no rows. Other columns are ignored.
    """
    facts = document_facts(docs, host)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    facts = materialize(facts.withColumn("base_failed", failed), "facts")
    rates = host_rates(facts).withColumnRenamed("host", "of_host")
    out = facts.join(rates, facts["host"].eqNullSafe(rates["of_host"])).drop("of_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rate") <= max_rate))
