"""Benchmark decontamination: an FM-index per shard of training text, backward search of the test phrases.

A shard is a block of whole documents. Only runs of words that some phrase uses can hold an occurrence, so the index is
built over those runs, with the phrases' words as alphabet. All phrases are searched in step, one word at a time, through
the ranks of a wavelet matrix; occurrences are found from sampled suffix positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.texts import ALNUM, BASE, FOLD, U64, blocks, hash_spans, mix, text_buffer, word_spans
from gleanery.sources.shared import materialize

WINDOW = 13
#: Benchmark text held by one pass over the documents at most; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20
#: Stands for a missing id.
NO_ID = -(2**63)


class FMIndex:
    """Over symbols 1 .. sigma - 1, with 0 as the end of each run; runs' ends differ, the later run's is larger."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = 8) -> None:
        n = len(seq)
        sa = self._suffixes(seq)
        bwt = seq[sa - 1]
        self.n, self.first = n, np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        # wavelet matrix: for each bit from the top, the ones before each place, and the number of zeros
        self.levels, now = [], bwt
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = (now >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(b)]).astype(np.int32), int(n - b.sum())))
            now = np.concatenate([now[b == 0], now[b == 1]])
        self.bwt = bwt
        sampled = (sa % every == 0) | (seq[sa - 1] == 0)
        self.marks = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = sa[sampled].astype(np.int32)

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        n = len(seq)
        ends = np.flatnonzero(seq == 0)
        rank = seq.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        order, k = np.argsort(rank, kind="stable"), 1
        while True:
            new = np.concatenate([[0], np.cumsum(rank[order][1:] != rank[order][:-1])])
            rank[order] = new
            if new[-1] == n - 1:
                return order
            after = np.zeros(n, np.int64)
            after[:-k] = rank[k:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank, k = key, 2 * k

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low = np.where(up, zeros + a, low - a)
            high = np.where(up, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each pattern; rows of ``patterns`` are padded at their end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            s = patterns[live, lengths[live] - back]
            low[live] = self.first[s] + self.rank(s, low[live])
            high[live] = self.first[s] + self.rank(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            go = np.flatnonzero(self.marks[at + 1] == self.marks[at])
            if not len(go):
                return self.samples[self.marks[at]] + steps
            s = self.bwt[at[go]]
            at[go] = self.first[s] + self.rank(s, at[go])
            steps[go] += 1


@dataclass
class Phrases:
    """Distinct phrases over a sorted vocabulary of word hashes (symbol i + 1 is word i) and the items that have them."""

    vocabulary: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    #: Of each phrase the word that the benchmark has least often.
    rarest: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, ids: np.ndarray, window: int = WINDOW) -> Phrases:
        data, offsets = text_buffer(texts)
        data = FOLD[data]
        starts, ends, rows = word_spans(data, offsets, ALNUM)
        vocabulary, symbols, often = np.unique(hash_spans(data, starts, ends), return_inverse=True, return_counts=True)
        # one row a window, in 32 bits; an item of fewer words, but not none, is one row, padded with zeros
        size = np.bincount(rows, minlength=len(ids))
        first = np.cumsum(size) - size
        count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        item = np.repeat(np.arange(len(ids)), count)
        begin = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[item]
        padded = np.concatenate([symbols + 1, np.zeros(window, np.int64)]).astype(np.int32)
        words = np.lib.stride_tricks.sliding_window_view(padded, window)[begin]
        lengths = np.minimum(size[item], window)
        words[np.arange(window) >= lengths[:, None]] = 0
        key = np.zeros(len(words), U64)
        for j in range(window):
            key = mix(key + words[:, j].astype(U64)) * BASE
        key, one, which = np.unique(key, return_index=True, return_inverse=True)
        owners = np.unique(which * max(1, len(ids)) + item)
        words, lengths = words[one], lengths[one]
        often = np.concatenate([[len(rows) + 1], often])[words]
        rarest = words[np.arange(len(words)), often.argmin(1)] if len(words) else lengths
        starts = np.searchsorted(owners // max(1, len(ids)), np.arange(len(words) + 1))
        return cls(vocabulary, words, lengths, rarest, starts, np.asarray(ids)[owners % max(1, len(ids))])

    def among(self, seen: np.ndarray) -> np.ndarray:
        """Numbers of the phrases all of whose words are ``seen`` (by symbol): first by their rarest word, then by all."""
        pick = np.flatnonzero(seen[self.rarest])
        return pick[(seen[self.words[pick]] | (self.words[pick] == 0)).all(1)]


def occurrences(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """Words per row; and row, first word, length and phrase of each occurrence, with the words' byte spans."""
    data, offsets = text_buffer(column)
    starts, ends, rows = word_spans(data, offsets, ALNUM)
    counts = np.bincount(rows, minlength=len(column))
    none = np.zeros(0, np.int64)
    nothing = counts, none, none, none, none, starts - offsets[rows], ends - offsets[rows]
    if not len(rows) or not len(phrases.lengths):
        return nothing
    hashes = hash_spans(FOLD[data], starts, ends)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    # runs of known words inside a row, none shorter than the shortest phrase
    edge = np.ones(len(rows) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])
    cuts = np.flatnonzero(edge)
    keep = known[cuts[:-1]] & (np.diff(cuts) >= phrases.lengths.min())
    first, size = cuts[:-1][keep], np.diff(cuts)[keep]
    if not len(first):
        return nothing
    place = np.arange(int((size + 1).sum()))
    to = np.cumsum(size + 1) - size - 1
    word = place - np.repeat(to, size + 1) + np.repeat(first, size + 1)
    stop = np.zeros(len(place), bool)
    stop[to + size] = True
    seq = np.where(stop, 0, at[np.minimum(word, len(at) - 1)] + 1)
    seen = np.zeros(len(phrases.vocabulary) + 1, bool)
    seen[seq] = True
    asked = phrases.among(seen)
    if not len(asked):
        return nothing
    # the alphabet is the words that are there
    symbol = np.cumsum(seen) - 1 if seen[0] else np.cumsum(seen)
    index = FMIndex(symbol[seq], int(symbol[-1]) + 1)
    low, high = index.search(symbol[phrases.words[asked]], phrases.lengths[asked])
    hit = np.flatnonzero(high > low)
    many = high[hit] - low[hit]
    which = np.repeat(asked[hit], many)
    suffix = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many)
    begin = word[index.locate(suffix)] if len(suffix) else none
    return counts, rows[begin] if len(begin) else none, begin, phrases.lengths[which], which, starts - offsets[rows], ends - offsets[rows]


OUT = "n_words long, spans array<struct<first:long,last:long,start:long,stop:long>>, items array<long>"
RESULTS = ("n_words", "spans", "items")
ROW = "_gleanery_row"


def _search(shared, hits_only: bool = False):
    """The batches' columns with what was found; with ``hits_only`` the rows where something was, without their texts."""
    kind = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "stop")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for b in blocks(batches, 4 << 20):
            counts, rows, begin, size, which, starts, ends = occurrences(b.column("text"), phrases)
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + size, -1)
            hit = np.cumsum(cover)[:-1] > 0
            bounds = np.concatenate([[0], np.cumsum(counts)])
            edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
            spans: list[list] = [[] for _ in range(b.num_rows)]
            for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)):
                while s < e:  # a run of hit words may pass from one row to the next
                    r = int(np.searchsorted(bounds, s, "right")) - 1
                    to = min(e, bounds[r + 1])
                    spans[r].append({"first": s - bounds[r], "last": to - 1 - bounds[r], "start": starts[s], "stop": ends[to - 1]})
                    s = to
            items: list[set] = [set() for _ in range(b.num_rows)]
            for r, p in {*zip(rows.tolist(), which.tolist())}:
                items[r].update(phrases.items[phrases.item_starts[p] : phrases.item_starts[p + 1]].tolist())
            names = [n for n in b.schema.names if not hits_only or n != "text"]
            cols = [*(b.column(n) for n in names), pa.array(counts, pa.int64())]
            cols += [pa.array(spans, pa.list_(kind)), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(cols, [*names, *RESULTS])
            yield out.filter(pa.array([bool(x) for x in items], pa.bool_())) if hits_only else out

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, the merged ``spans`` of hit words (first and last word, byte range) and the ``items`` found.

    A phrase is a run of ``window`` words of an item, or the whole of a shorter one; words are runs of ASCII letters,
    digits and characters beyond ASCII, A-Z lowered. Null texts have no words. One row per row of ``docs``; repeated
    rows and null ids are rows like others; an empty benchmark finds nothing. Items are named by their ids, so items that
    share one count once; those without an id are one item whose name is null. Other columns stay, but for those that have a
    result's name, which the result replaces.

    A benchmark beyond ``BLOCK_BYTES`` is dealt into blocks of that size. The driver holds one block at a time; each is searched
    in a pass of its own over the documents, numbered and written for that, and the passes' spans and items are merged.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    docs = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names))
    items = benchmark.where("text is not null")
    items = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(total) // BLOCK_BYTES

    def block(k: int):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        got = mine.toArrow().combine_chunks()
        texts, ids = (got.column(c).combine_chunks() if got.num_rows else pa.array([], t) for c, t in (("text", pa.string()), ("item_id", pa.int64())))
        return spark.sparkContext.broadcast(Phrases.of(texts, np.asarray(ids), window))

    kept, hits = docs, None
    if parts > 1:
        kept = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered", compression="zstd")
        for k in range(1, parts):
            shared = block(k)
            found = kept.select(ROW, "text").mapInArrow(_search(shared, True), f"{ROW} long, {OUT}")
            found = materialize(found.select(ROW, "spans", "items"), "hits")
            shared.destroy()
            hits = found if hits is None else hits.unionByName(found)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    out = kept.mapInArrow(_search(block(0)), f"{schema}, {OUT}")
    if hits is not None:
        more = hits.groupBy(ROW).agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
        none = F.array().cast("array<long>")
        out = out.join(more, ROW, "left").withColumns(
            {
                "spans": F.when(F.col("_spans").isNull(), F.col("spans")).otherwise(merge_spans(F.concat("spans", "_spans"))),
                "items": F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", none)))),
            }
        )
    named = F.transform("items", lambda i: F.when(i != NO_ID, i)).alias("items")
    return out.select(*(F.col(f"`{c}`") for c in names), "n_words", "spans", named)


def merge_spans(spans):
    """Overlapping or touching spans as one, in order."""
    kind = "array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= s["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"),
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`find_contamination` with ``n_hit``, ``n_items`` and ``contaminated`` (a twentieth of the words, or more, hit);
    these replace columns of their names, too."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    out = find_contamination(docs, benchmark, window).withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def removed(text: str | None, spans: list) -> str | None:
    """A text without its spans' bytes."""
    if text is None or not spans:
        return text
    data, at, kept = text.encode(), 0, []
    for s in spans:
        kept.append(data[at : s["start"]])
        at = s["stop"]
    return b"".join([*kept, data[at:]]).decode()


def remove_spans(found: DataFrame) -> DataFrame:
    """:func:`find_contamination`'s rows with the spans cut out of ``text``; all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 4 << 20):
            texts = [removed(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)
