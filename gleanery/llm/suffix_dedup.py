"""Exact removal of repeated byte strings with a run-length index.

Every ``length``-byte window of a document has an anchor, its smallest hashed gram; equal windows have equal anchors at
the same place. Windows in a row with one anchor form a segment. Segments whose anchor occurs once can hold no repeat
and are dropped. Of the others each distinct text is kept once, with its first place; later occurrences are repeats as a
whole. Distinct segments are dealt to shards by anchor, so equal windows meet in one shard, and each shard builds the
run-length Burrows-Wheeler transform of its segments, with suffix positions sampled at the run ends. The positions are
then streamed through it: each one's lexicographic neighbour comes from the samples, the matching length from the text,
and windows that match an earlier one over their whole length are marked.

An anchor with very many distinct segments, like the edge of a passage that many documents share, is split: its segments
are cut into pieces of a few windows at the same places beside the anchor, and the pieces take the part of segments. They are
dealt by what all their windows have in common, so that one anchor fills many shards, and equal pieces meet once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.texts import BASE, BYTE_VALUES, U64, blocks, mix, powers, text_buffer
from gleanery.sources.shared import free_shuffles, materialize, release

GRAM = 24
#: Bytes of text that a task works on at once, whole rows always.
BLOCK_BYTES = 1 << 20
#: Bytes of distinct segments per shard, about.
SHARD_BYTES = 1 << 20
#: Bits at most of each of the two filters of repeated anchors that are sent to the tasks, and of one part of them.
FILTER_BITS, PART_BITS = 1 << 28, 1 << 22
#: An anchor with more segments than this, counted once a block, is split into pieces of so many windows.
HOT_SEGMENTS, PIECE_WINDOWS = 4096, 4
#: A missing id is the smallest.
NO_ID = -(2**63)

_inverse = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        factors = np.full(max(n, 4096), U64(pow(int(BASE), -1, 1 << 64)), U64)
        factors[0] = 1
        _inverse = np.cumprod(factors, dtype=U64)
    return _inverse[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data) + 1)[:-1], out=out[1:])
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first byte, end, anchor hash and text hash of the segments, in order. ``data`` has at most 2 ** 24 bytes,
    but for a single row, whose windows' ties are then told apart by their low position bits alone."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(U64), none.view(U64)
    prefix, inverse = prefix_hashes(data), inverse_powers(n + 1)
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    bits = U64(max(24, int(n).bit_length()))
    low = (U64(1) << bits) - U64(1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=U64)
    pad = -len(packed) % width
    grid = np.concatenate([packed, np.full(pad, U64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[: len(packed) - width + 1], ahead[width - 1 : len(packed)]) & low).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(at)), "right") - 1
    start = np.flatnonzero(np.arange(len(at)) + length <= offsets[row + 1])
    if not len(start):
        return none, none, none, none.view(U64), none.view(U64)
    a, r = at[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    begin, end = start[first], start[np.append(first[1:], len(start)) - 1] + length
    text = mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(U64))
    return r[first], begin, end, grams[a[first]], text


class RunLengthIndex:
    """The run-length Burrows-Wheeler transform of a text, with suffix positions at the ends of its runs."""

    def __init__(self, text: np.ndarray) -> None:
        """``text``: symbols 0 .. 510; 0 ends a segment."""
        order = suffix_order(text)
        self.text, last = text, np.where(order == 0, -1, text[order - 1])  # nothing stands before the whole text
        head = np.ones(len(text), bool)
        head[1:] = last[1:] != last[:-1]
        starts = np.flatnonzero(head)
        self.symbols, self.lengths = last[starts], np.diff(np.append(starts, len(text)))
        # the suffix at the start of each run, and the one at the end of the run before
        heads, ends = order[starts], order[starts - 1]
        by = np.argsort(heads)
        self.heads, self.ends = heads[by], ends[by]

    def neighbours(self, at: np.ndarray) -> np.ndarray:
        """The suffix just before each given one in lexicographic order; -1 before the first is the last."""
        k = np.searchsorted(self.heads, at, "right") - 1
        return self.ends[k] + (at - self.heads[k])

    def matches(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours, and whether the text at each position equals that at its neighbour over ``length`` symbols."""
        near = self.neighbours(at)
        live = np.flatnonzero((near >= 0) & (near + length <= len(self.text)))
        for i in range(0, length, 4):
            step = slice(i, min(i + 4, length))
            for j in range(step.start, step.stop):
                live = live[self.text[at[live] + j] == self.text[near[live] + j]]
        same = np.zeros(len(at), bool)
        same[live] = True
        return near, same


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling on those not yet told apart."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : n + j]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    done, depth = new & np.append(new[1:], True), 7
    todo = np.flatnonzero(~done)
    while len(todo):
        at = order[todo]
        key = (rank[at] << 32) | (rank[np.minimum(at + depth, n)] + 1)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[todo] = at
        new = np.ones(len(todo), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[at] = np.repeat(todo[first], np.diff(np.append(first, len(todo))))
        todo, depth = todo[~(new & np.append(new[1:], True))], depth * 2
    return order


def first_matches(index: RunLengthIndex, at: np.ndarray, length: int) -> np.ndarray:
    """The first of ``at`` whose window equals each one's, by following matching neighbours to their class's end."""
    near, same = index.matches(at, length)
    place = np.full(len(index.text), -1)
    place[at] = np.arange(len(at))
    up = np.arange(len(at))
    up[same] = place[near[same]]
    while True:  # windows match only windows, so every neighbour followed is one of ``at``
        further = up[up]
        if (further == up).all():
            break
        up = further
    least = np.full(len(at), len(index.text))
    np.minimum.at(least, up, at)
    return least[up]


def repeated_spans(ids: np.ndarray, begins: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment numbers and byte ranges, inside each segment, of windows that an earlier window equals. Segments come in
    the order of their places."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    data[starts + sizes] = 0
    count = sizes - length + 1
    segment = np.repeat(np.arange(len(texts)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + starts[segment]
    again = first_matches(RunLengthIndex(data), at, length) != at
    at, segment = at[again], segment[again]
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (at[1:] > at[:-1] + length)
    first = np.flatnonzero(new)
    of = segment[first]
    return of, at[first] - starts[of], at[np.append(first[1:], len(at)) - 1] + length - starts[of]


def _anchor_counts(length: int, gram: int):
    """Per anchor of a block: its occurrences, and the smallest and largest text hash of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            *_, anchor, text = segments(*text_buffer(b.column("text")), length, gram)
            anchor, text = anchor.view(np.int64), text.view(np.int64)
            order = np.lexsort((text, anchor))
            anchor, text = anchor[order], text[order]
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            first = np.flatnonzero(new)
            end = np.append(first[1:], len(anchor))
            cols = [anchor[first], end - first, text[first], text[end - 1]] if len(first) else [anchor] * 4
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["anchor", "n", "least", "most"])

    return run


def _filter_part(size: int):
    """A part of the filters: the bits of its repeated anchors, and of those with several texts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = np.asarray(table.column("bit").combine_chunks())
        both = []
        for places in (at, at[np.asarray(table.column("varied").combine_chunks().cast(pa.int8())) > 0]):
            bits = np.zeros(size, np.uint8)
            bits[places % size] = 1
            both.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "repeated": pa.array([both[0]], pa.binary()), "varied": pa.array([both[1]], pa.binary())})

    return run


def anchor_filters(found: DataFrame, anchors: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit maps of the anchors' low bits, of bounded size: all repeated anchors, and those with several texts. The bits are
    set in Spark, part by part; other anchors with such low bits pass, too, which costs work but changes no result."""
    bits = PART_BITS
    while bits < min(16 * anchors, FILTER_BITS):
        bits *= 2
    at = found.groupBy(F.col("anchor").bitwiseAND(F.lit(bits - 1)).alias("bit")).agg(F.max("varied").alias("varied"))
    parts = at.withColumn("part", (F.col("bit") / PART_BITS).cast("int")).groupBy("part")
    rows = parts.applyInArrow(_filter_part(PART_BITS), "part int, repeated binary, varied binary").collect()
    out = np.zeros((2, bits // PART_BITS, PART_BITS // 8), np.uint8)
    for r in rows:
        out[0, r.part], out[1, r.part] = np.frombuffer(r.repeated, np.uint8), np.frombuffer(r.varied, np.uint8)
    return out[0].ravel(), out[1].ravel()


def _passes(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = (anchor & U64(len(bits) * 8 - 1)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


SEGMENT = "doc_id long, anchor long, segment long, begin int, size int, body binary"


def _segments(length: int, gram: int, filters):
    """Segments of repeated anchors; the first of each text in a block carries it, if its anchor has several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, varied = filters.value
        for b in blocks(batches, BLOCK_BYTES):
            data, offsets = text_buffer(b.column("text"))
            row, begin, end, anchor, text = segments(data, offsets, length, gram)
            keep = _passes(repeated, anchor)
            row, begin, end, anchor, text = row[keep], begin[keep], end[keep], anchor[keep], text[keep]
            once = np.zeros(len(row), bool)
            once[np.unique(text, return_index=True)[1]] = True
            once &= _passes(varied, anchor)
            raw = data.tobytes()
            bodies = [raw[s:e] if o else None for s, e, o in zip(begin.tolist(), end.tolist(), once.tolist())]
            ids = np.asarray(b.column("doc_id"))[row]
            cols = [ids, anchor.view(np.int64), text.view(np.int64), (begin - offsets[row]).astype(np.int32), (end - begin).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(bodies, pa.binary())], [x.split()[0] for x in SEGMENT.split(", ")])

    return run


def pieces(body: bytes, anchor: int, length: int, gram: int, windows: int = PIECE_WINDOWS) -> list[tuple[int, int, int, int]]:
    """Start, end, key and text hash of a segment's pieces: its windows by their places beside the anchor, ``windows`` places
    a piece. Equal windows lie in pieces of one key, which hashes the anchor, the places and the bytes common to them."""
    data = np.frombuffer(body, np.uint8)
    n = len(data)
    prefix, inverse = prefix_hashes(data), inverse_powers(n + 1)
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    at = n - length + int(np.argmax(grams[n - length :] == U64(anchor)))  # the leftmost in the last window
    first, last = at // windows, (at - (n - length)) // windows
    block = np.arange(last, first + 1)
    start, stop = np.maximum(at - block * windows - windows + 1, 0), np.minimum(at - block * windows, n - length) + length
    low, high = at - block * windows, at - (block + 1) * windows + 1 + length
    common = (prefix[high] - prefix[low]) * inverse[low]
    key = mix(mix(common + U64(anchor)) + block.astype(U64))
    text = mix(mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(U64)) + key)
    return list(zip(start.tolist(), stop.tolist(), key.view(np.int64).tolist(), text.view(np.int64).tolist()))


def _pieces(length: int, gram: int):
    """The pieces of segments, as segments whose anchor is the pieces' key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, anchor, begin, body in zip(*(b.column(c).to_pylist() for c in ("doc_id", "anchor", "begin", "body"))):
                for s, e, key, text in pieces(body, anchor % 2**64, length, gram):
                    out.append((doc, key, text, begin + s, e - s, body[s:e]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            cols = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SEGMENT.split(", ")])

    return run


def _mark(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("begin", "ascending")])
        ids, begin = np.asarray(table.column("doc_id")), np.asarray(table.column("begin")).astype(np.int64)
        of, start, stop = repeated_spans(ids, begin, table.column("body").to_pylist(), length)
        cols = [ids[of], (begin[of] + start).astype(np.int32), (begin[of] + stop).astype(np.int32)]
        return pa.table(list(map(pa.array, cols)), ["doc_id", "start", "stop"])

    return run


def merge(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), stops.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


#: Columns of the work in between.
ID, SPANS = "_gleanery_id", "_gleanery_spans"
FACTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(columns: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            facts, texts = [], []
            for text, spans in zip(b.column("text"), b.column(SPANS)):
                data, kept, at = (text.as_buffer().to_pybytes() if text.is_valid else b""), [], 0
                runs = _runs(spans)
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                rest = b"".join([*kept, data[at:]])
                facts.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
                if with_text:
                    texts.append(rest.decode("utf-8", "ignore") if text.is_valid else None)
            out = {c: b.column(c) for c in columns}
            if with_text:
                out["text"] = pa.array(texts, pa.string())
            for i, f in enumerate(FACTS.split(", ")):
                out[f.split()[0]] = pa.array([x[i] for x in facts])
            yield pa.RecordBatch.from_pydict(out)

    return run


def _runs(spans) -> list[tuple[int, int]]:
    if not spans.is_valid:
        return []
    starts, stops = (np.asarray(x) for x in spans.values.flatten())
    return merge(starts, stops)


def repeated_ranges(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """``(doc_id, start, stop)`` byte ranges, not yet merged, of all windows that start earlier elsewhere."""
    spark = docs.sparkSession
    count = docs.mapInArrow(_anchor_counts(length, gram), "anchor long, n long, least long, most long").groupBy("anchor")
    count = count.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = materialize(count.where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("varied")), "anchors")
    free_shuffles(spark)
    filters = spark.sparkContext.broadcast(anchor_filters(found, found.count()))
    release(found)
    segs = materialize(docs.mapInArrow(_segments(length, gram, filters), SEGMENT), "segments", compression="zstd")

    # an anchor whose segments have one text holds no repeat but the later occurrences of the whole segment
    held = segs.where("body is not null")
    hot = materialize(held.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SEGMENTS).select("anchor"), "hot")
    if not hot.count():
        return _repeats(segs, held, length)
    hot_texts = _first(segs, held.join(hot, "anchor", "left_semi")).select("doc_id", "anchor", "begin", "body")
    cut = materialize(hot_texts.mapInArrow(_pieces(length, gram), SEGMENT), "pieces", compression="zstd")
    return _repeats(segs, held.join(hot, "anchor", "left_anti"), length).unionByName(_repeats(cut, cut, length))


def _first(segs: DataFrame, held: DataFrame) -> DataFrame:
    """``(anchor, segment, doc_id, begin, body)``: each distinct segment that ``held`` has a text of, at its first place."""
    places = segs.groupBy("segment").agg(F.min(F.struct("doc_id", "begin")).alias("first"))
    texts = held.groupBy("anchor", "segment").agg(F.min("body").alias("body"))
    return texts.join(places, "segment").select("anchor", "segment", "first.doc_id", "first.begin", "body")


def _repeats(segs: DataFrame, held: DataFrame, length: int) -> DataFrame:
    """Ranges of the later occurrences of segments, and of windows inside ``held`` ones that an earlier segment has."""
    spark = segs.sparkSession
    shards = 1 + int(held.agg(F.sum("size")).first()[0] or 0) // (2 * SHARD_BYTES)
    places = materialize(segs.groupBy("segment").agg(F.min(F.struct("doc_id", "begin")).alias("first")), "places")
    texts = held.groupBy("anchor", "segment").agg(F.min("body").alias("body")).join(places, "segment")
    dealt = texts.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "first.doc_id", "first.begin", "body")
    marked = materialize(dealt.groupBy("shard").applyInArrow(_mark(length), "doc_id long, start int, stop int"), "marked")
    free_shuffles(spark)

    later = segs.select("segment", "doc_id", "begin", "size").join(places, "segment")
    later = later.where("doc_id <> first.doc_id or begin <> first.begin")
    return later.select("doc_id", F.col("begin").alias("start"), (F.col("begin") + F.col("size")).alias("stop")).unionByName(marked)


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``, one row per row, and their remaining text.

    A byte goes if a ``length``-byte string that covers it also starts earlier, in a smaller ``doc_id`` or before in the same
    document; matches never cross documents, and strings are judged on the input. Texts are their UTF-8 bytes; a null
    text has none. What remains as text leaves out characters cut in two; the facts count all bytes. Ids are integers; a
    null id is the smallest. Ids should be unique: rows that are alike get the same result, as one document, and
    texts that share an id are judged as one document's. An empty table gives no rows. Without ``with_text`` the text
    column is left out. Other columns stay, but for those that have a result's name, which the result replaces.
    """
    results = {f.split()[0] for f in FACTS.split(", ")}
    names = [c for c in docs.columns if c.lower() != "text" and c.lower() not in results]
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias("text")).withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    ranges = repeated_ranges(keyed.select(F.col(ID).alias("doc_id"), "text"), length, gram)
    spans = ranges.groupBy(F.col("doc_id").alias(ID)).agg(F.collect_list(F.struct("start", "stop")).alias(SPANS))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = [f"`{c}` {kinds[c]}" for c in names] + ["text string"] * with_text + [FACTS]
    joined = keyed.join(spans, ID, "left").select(*(F.col(f"`{c}`") for c in names), "text", SPANS)
    return joined.mapInArrow(_cut(names, with_text), ", ".join(schema))
