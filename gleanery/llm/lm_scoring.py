"""Language-model scores of documents by n-gram tries that are sharded by context.

Documents are read once, in blocks: a block's token stream and its word table are written to the shared folder. Word counts
come from the word tables alone, dealt by word hash. Then each block sends its distinct trigrams, with the training count of
each word, to the shards of their contexts. A shard counts the training trigrams, builds its trie, maps it from a scratch
file, looks all trigrams up and returns log probabilities summed per document. All that moves is packed arrays.

The model is one trigram model, whatever the shards. A context with more tokens than a shard should hold is spread over
several shards by the word before it: that divides its trigrams, but not its bigrams. So the bigrams after such contexts
are counted beforehand, dealt by their own hash, and the blocks send their finished probability in place of the word's
count. Pairs of words that are still too frequent have their trigrams counted the same way, and the block settles those
by itself. Only the numbers of distinct successors of these contexts go through the driver, of two million contexts at most.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.ngram_trie import NgramTrie, pack, unpack
from gleanery.llm.texts import BASE, FOLD, SPACED, U64, blocks, hash_spans, mix, text_buffer, word_spans
from gleanery.sources.shared import delete, free_shuffles, materialize, new_path

END = U64(2)
#: Bytes of text in a block, tokens in a part of a shard, parts of a shard (each a trie, one after another), words of a block in
#: a word shard: about.
BLOCK_BYTES, PART_TOKENS, PARTS, SHARD_WORDS = 6 << 20, 600_000, 2, 1_500_000
#: Steps of a finished bigram's quantised log10 probability: 16 bits hold it down to 1e-16.
CODES = 4096
#: A context of one word with more training tokens than this is spread, so that shards even out, and one of two words with more
#: than the second number is settled by the blocks; but at most so many contexts are.
SPREAD_TOKENS, SETTLED_TOKENS, MOST_SPREAD = PART_TOKENS // 8, PART_TOKENS, 2_000_000
#: Word counts as sent to the shards, in 8 bits: exact to 64, then eight steps an octave.
LEVELS = np.concatenate([np.arange(64.0), 64 * 2 ** (np.arange(192) / 8)])


def _squeeze(arrays: dict[str, np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pack(arrays))


def _expand(raw: bytes) -> dict[str, np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(raw))


#: The arrays of a request, in order; their lengths and bytes an item are its head.
REQUEST = ("parts", "of", "n", "held", "spread", "level", *(f"{x}.{y}" for x in ("finished", "context", "two", "word", "row") for y in ("planes", "width")))


def _squeeze_request(arrays: dict[str, np.ndarray]) -> bytes:
    head = np.array([[len(arrays[k]), arrays[k].itemsize] for k in REQUEST], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(arrays[k]).tobytes() for k in REQUEST)]))


def _expand_request(raw: bytes) -> dict[str, np.ndarray]:
    data, out = zstandard.ZstdDecompressor().decompress(raw), {}
    head, at = np.frombuffer(data, np.uint32, 2 * len(REQUEST)).reshape(-1, 2).tolist(), 8 * len(REQUEST)
    for k, (n, width) in zip(REQUEST, head):
        out[k] = np.frombuffer(data, f"<u{width}", n, at)
        at += n * width
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the fewest whole bytes."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _planes(a: np.ndarray, name: str = "") -> dict[str, np.ndarray]:
    """Non-negative integers as byte planes, low bytes first, as many as the largest needs: what is alike lies together."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()
    return {name + "planes": planes, name + "width": np.array([width], np.uint8)}


def _from_planes(a: dict[str, np.ndarray], name: str = "") -> np.ndarray:
    width = int(a[name + "width"][0])
    out = np.zeros((len(a[name + "planes"]) // width, 8), np.uint8)
    out[:, :width] = a[name + "planes"].reshape(width, -1).T
    return out.view("<u8").ravel()


def _sorted_planes(a: np.ndarray, name: str = "") -> dict[str, np.ndarray]:
    """Ascending 64-bit numbers, as differences."""
    return _planes(np.diff(a, prepend=U64(0)), name)


def _from_sorted_planes(a: dict[str, np.ndarray], name: str = "") -> np.ndarray:
    return np.cumsum(_from_planes(a, name), dtype=U64)


def _range_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of ascending hashes begins and ends; shards are equal ranges of hashes."""
    top = (keys >> U64(32)) * U64(shards) >> U64(32)
    return np.searchsorted(top, np.arange(shards + 1, dtype=U64))


def _level(c: np.ndarray) -> np.ndarray:
    return np.searchsorted((LEVELS[1:] + LEVELS[:-1]) / 2, c).astype(np.uint8)


def _batch(columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for _, kind, values in columns], [name for name, _, _ in columns])


def _tokens(word_shards: int):
    """Of each block its token stream (``kind`` stream), and its words and training counts by word shard (``kind`` words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            data, offsets = text_buffer(b.column("text"))
            data = FOLD[data]
            starts, ends, rows = word_spans(data, offsets, SPACED)
            counts = np.bincount(rows, minlength=b.num_rows) + 1
            stream = np.empty(int(counts.sum()), U64)
            last = np.cumsum(counts) - 1
            stream[last] = END
            inner = np.ones(len(stream), bool)
            inner[last] = False
            stream[inner] = np.maximum(hash_spans(data, starts, ends), U64(3))
            words, local = np.unique(stream, return_inverse=True)
            held = np.asarray(b.column("held_out").cast(pa.int8()))
            n = np.bincount(local, np.repeat(held == 0, counts), len(words)).astype(np.int64)
            block = int(np.random.default_rng().integers(1 << 62))
            body = {"stream": _small(local), "counts": _small(counts), "ids": np.asarray(b.column("doc_id")), "held": held}
            body["known"] = np.asarray(b.column("has_id").cast(pa.int8()))
            out = [(-1, _squeeze(body), "stream")]
            cut = _range_shards(words, word_shards).tolist()
            for k, (s, e) in enumerate(zip(cut, cut[1:])):
                if s < e:
                    out.append((k, _squeeze({**_sorted_planes(words[s:e]), "n": _small(n[s:e])}), "words"))
            shard, body, kind = zip(*out)
            yield _batch([("block", pa.int64(), [block] * len(out)), ("shard", pa.int32(), shard), ("body", pa.binary(), body), ("kind", pa.string(), kind)])

    return run


def _count(table: pa.Table) -> pa.Table:
    """Training counts and frequency ranks of a word shard, for each block in the order it asked, with the shard's own
    totals once."""
    asked = [_expand(x) for x in table.column("body").to_pylist()]
    words = [_from_sorted_planes(a) for a in asked]
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate([a["n"] for a in asked]), len(every)).astype(np.int64)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(every))
    cuts = np.cumsum([len(w) for w in words])[:-1]
    got = zip(np.split(total[at], cuts), np.split(rank[at], cuts))
    once = np.arange(len(asked)) == 0
    return pa.table(
        {
            "block": table.column("block"),
            "shard": table.column("shard"),
            "body": pa.array([_squeeze({"c": _small(c), "rank": _small(r)}) for c, r in got], pa.binary()),
            "tokens": pa.array(np.where(once, total.sum(), 0)),
            "types": pa.array(np.where(once, (total > 0).sum(), 0)),
            "most": pa.array(np.where(once, total.max(initial=0), 0)),
        }
    )


@dataclass
class Corpus:
    """What the whole corpus says of itself: totals, and the spread contexts' numbers of distinct successors."""

    tokens: int
    types: int
    docs: int
    word_shards: int
    gram_shards: int
    shards: int
    #: Contexts of one word with more training tokens than the first are spread, of two with more than the second settled.
    limit: int
    settled: int
    successors: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def lowest(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.types + 1))


class Block:
    """A block's tokens with their words' numbers and counts, and what is known of its spread contexts."""

    def __init__(self, r: dict, corpus: Corpus) -> None:
        self.id, self.corpus, self.body = r["block"], corpus, _expand(r["body"])
        parts = [(x["shard"], _expand(x["body"])) for x in sorted(r["parts"], key=lambda x: x["shard"])]
        # a word's number is small for frequent words; 0 is the place before a text, the last of both arrays
        self.c = np.concatenate([*(p["c"].astype(np.int64) for _, p in parts), [corpus.docs]])
        self.number = np.concatenate([*(p["rank"].astype(np.int64) * corpus.word_shards + k + 1 for k, p in parts), [0]])
        self.word, self.counts = self.body["stream"].astype(np.int64), self.body["counts"].astype(np.int64)
        self.rows, begin = np.repeat(np.arange(len(self.counts)), self.counts), len(self.c) - 1
        self.one, self.two = np.empty(len(self.word), np.int64), np.empty(len(self.word), np.int64)
        self.one[1:], self.two[2:] = self.word[:-1], self.word[:-2]
        first = np.cumsum(self.counts) - self.counts
        self.one[first] = self.two[first] = begin
        self.two[first[self.counts > 1] + 1] = begin
        self.train = self.body["held"][self.rows] == 0
        #: Tokens after spread contexts, the trigram's context among them, and each level's probability there.
        self.spread = np.flatnonzero(self.c[self.one] > corpus.limit)
        self.p2, self.pair, self.p3 = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        if r.get("pairs") is not None and len(self.spread):
            self._know_pairs(r["pairs"], r.get("triples"))

    def _keys(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the contexts of ``size`` words and of the whole n-grams, of the tokens ``at``."""
        context = mix(self.number[self.one[at]].astype(U64) + U64(1))
        if size == 2:
            context = mix(context * BASE + self.number[self.two[at]].astype(U64))
        return context, mix(context * BASE + self.number[self.word[at]].astype(U64))

    def grams(self, at: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
        """The distinct n-grams of the tokens ``at``, with their contexts and training counts, by shard."""
        context, key = self._keys(at, size)
        keys, first, of = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(of, self.train[at], len(keys)).astype(np.int64)
        contexts, which = np.unique(context[first], return_inverse=True)
        cut = _range_shards(keys, self.corpus.gram_shards).tolist()
        for k, (s, e) in enumerate(zip(cut, cut[1:])):
            if s < e:
                mine, index = np.unique(which[s:e], return_inverse=True)
                yield k, _squeeze({**_sorted_planes(keys[s:e]), "n": _small(n[s:e]), "context": _small(index), "contexts": contexts[mine]})

    def _smooth(self, at: np.ndarray, size: int, replies: list, total: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the tokens ``at`` and the training count of their n-grams."""
        context, key = self._keys(at, size)
        _, of = np.unique(key, return_inverse=True)
        c = np.concatenate([_expand(x["body"])["c"].astype(np.int64) for x in sorted(replies, key=lambda x: x["shard"])])[of]
        known, types = self.corpus.successors[size - 1]
        distinct, which = np.unique(context, return_inverse=True)
        k = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        types = np.where(known[k] == distinct, types[k], 0)[which]
        return np.maximum(c - NgramTrie.DISCOUNT, 0) / total + NgramTrie.DISCOUNT * types / total * below, c

    def _know_pairs(self, pairs: list, triples: list | None) -> None:
        at = self.spread
        self.p2, c = self._smooth(at, 1, pairs, self.c[self.one[at]], self.corpus.lowest(self.c[self.word[at]]))
        # how often the context's two words follow each other: the count of the pair that ends one token before
        count = np.zeros(len(self.word), np.int64)
        count[at] = c
        begin = len(self.c) - 1
        before = np.where(self.one[at] == begin, self.corpus.docs, count[at - 1])
        self.pair = np.flatnonzero(before > self.corpus.settled)
        if triples is not None and len(self.pair):
            self.p3, _ = self._smooth(at[self.pair], 2, triples, before[self.pair], self.p2[self.pair])


def _grams(shared, size: int):
    """The n-grams after the spread contexts of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r, shared.value)
                at = b.spread if size == 1 else b.spread[b.pair]
                if len(at):
                    out = list(b.grams(at, size))
                    yield _batch([("block", pa.int64(), [b.id] * len(out)), ("shard", pa.int32(), [o[0] for o in out]), ("body", pa.binary(), [o[1] for o in out])])

    return run


GRAMS = "block long, shard int, body binary, most long, context long, successors long"


def _count_grams(table: pa.Table) -> pa.Table:
    """Training counts of a shard's n-grams for each block in the order it asked, and the distinct successors that this shard
    has of each context, in rows without a body."""
    asked = [_expand(x) for x in table.column("body").to_pylist()]
    keys = [_from_sorted_planes(a) for a in asked]
    every, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(at, np.concatenate([a["n"] for a in asked]), len(every)).astype(np.int64)
    context = np.concatenate([a["contexts"][a["context"]] for a in asked])[first]
    contexts, of = np.unique(context, return_inverse=True)
    types = np.bincount(of, total > 0, len(contexts)).astype(np.int64)
    got = [_squeeze({"c": _small(x)}) for x in np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])]
    none, blocks_ = [None] * len(contexts), table.column("block").to_pylist()
    return pa.table(
        [
            pa.array([*blocks_, *(blocks_[i % len(blocks_)] for i in range(len(contexts)))], pa.int64()),
            pa.array([*table.column("shard").to_pylist(), *none], pa.int32()),
            pa.array([*got, *none], pa.binary()),
            pa.array([int(total.max(initial=0))] * len(got) + none, pa.int64()),
            pa.array([None] * len(got) + contexts.view(np.int64).tolist(), pa.int64()),
            pa.array([None] * len(got) + types.tolist(), pa.int64()),
        ],
        [x.split()[0] for x in GRAMS.split(", ")],
    )


def _requests(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r, shared.value)
                out = list(_block_requests(b))
                cols = [("block", pa.int64(), [b.id] * len(out)), ("shard", pa.int32(), [o[0] for o in out])]
                yield _batch([*cols, ("facts", pa.bool_(), [o[2] for o in out]), ("body", pa.binary(), [o[1] for o in out])])

    return run


def _block_requests(b: Block) -> Iterator[tuple[int, bytes, bool]]:
    corpus = b.corpus
    base = np.bincount(b.rows, np.log10(corpus.lowest(b.c))[b.word], len(b.counts))
    known = np.bincount(b.rows, b.c[b.word] > 0, len(b.counts)).astype(np.int64)
    settled = b.spread[b.pair[: len(b.p3)]]
    own = np.bincount(b.rows[settled], np.log10(b.p3), len(b.counts)) if len(settled) else np.zeros(len(b.counts))
    facts = {"ids": b.body["ids"], "known_id": b.body["known"], "held": b.body["held"], "tokens": b.counts, "known": known, "base": base, "own": own}
    yield b.id % corpus.shards, _squeeze(facts), True
    # the distinct trigrams of each row, but for those that are settled
    open_ = np.ones(len(b.word), bool)
    open_[settled] = False
    at = np.flatnonzero(open_)
    key = b._keys(at, 2)[1]
    # one sort by row and the key's upper bits: a trigram between whose tokens another with these bits falls is sent in parts
    order = np.argsort((b.rows[at].astype(U64) << U64(40)) | (key >> U64(24)))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (b.rows[at[order]][1:] != b.rows[at[order]][:-1])
    pick = at[order[new]]
    n = np.diff(np.append(np.flatnonzero(new), len(order)))
    finished = np.full(len(b.word), -1.0)
    if len(b.p2):
        finished[b.spread] = b.p2
    one, two, word, row, finished = b.one[pick], b.two[pick], b.word[pick], b.rows[pick], finished[pick]
    # a spread context's place depends on the word before, too
    classes = np.where(b.c > corpus.limit, b.c // corpus.limit + 1, 1)[one]
    kind = (mix(b.number[two].astype(U64) + BASE) % classes.astype(U64)).astype(np.int64)
    context = b.number[one] * (max(corpus.tokens, corpus.docs) // corpus.limit + 2) + kind
    distinct, which = np.unique(context, return_inverse=True)
    part = (mix(distinct.astype(U64)) % U64(corpus.shards * PARTS)).astype(np.int64)
    shard = part // PARTS
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.argsort(place[which] * len(which) + np.arange(len(which)))
    edges = np.searchsorted(shard[which[by]], np.arange(corpus.shards + 1))
    level = _level(b.c)
    for k in range(corpus.shards):
        s = by[edges[k] : edges[k + 1]]
        if not len(s):
            continue
        new = np.flatnonzero(np.append(True, context[s][1:] != context[s][:-1]))
        p = finished[s]
        send = {"parts": np.bincount(part[which[s]] % PARTS, minlength=PARTS).astype(np.uint32)}
        send |= {"of": _small(np.diff(np.append(new, len(s)))), "n": _small(n[s]), "held": np.packbits(b.body["held"][row[s]].astype(bool))}
        send |= {"spread": np.packbits(p[new] >= 0), "level": level[word[s]][p < 0]}
        send |= _planes(np.minimum(np.round(-np.log10(p[p >= 0]) * CODES), 65535).astype(np.int64), "finished.")
        columns = {"context.": np.diff(context[s][new].astype(U64), prepend=U64(0)), "two.": b.number[two[s]], "word.": b.number[word[s]], "row.": row[s]}
        for name, a in columns.items():
            send |= _planes(a, name)
        yield k, _squeeze_request(send), False


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shared):
    """Log probabilities of a shard's trigrams, part by part, summed by row and packed by block."""

    def run(table: pa.Table) -> pa.Table:
        out, asked = [], []
        for block, is_fact, body in zip(*(table.column(c).to_pylist() for c in ("block", "facts", "body"))):
            if is_fact:
                out.append((block, True, body))
            else:
                asked.append((block, Request(_expand_request(body))))
        for part in range(PARTS if asked else 0):
            mine = [a.part(part) for _, a in asked]
            each = _log_probabilities(mine, shared.value)
            for (_, a), p in zip(asked, np.split(each, np.cumsum([len(m["n"]) for m in mine])[:-1])):
                a.take(part, p)
        for block, a in asked:
            rows, at = np.unique(a.row, return_inverse=True)
            out.append((block, False, _squeeze({"total": np.bincount(at, a.score).astype(np.float32), **_sorted_planes(rows.astype(U64))})))
        return pa.table(_batch([("block", pa.int64(), [o[0] for o in out]), ("facts", pa.bool_(), [o[1] for o in out]), ("body", pa.binary(), [o[2] for o in out])]))

    return run


class Request:
    """What one block asks of a shard, part by part."""

    def __init__(self, a: dict[str, np.ndarray]) -> None:
        self.bounds = np.concatenate([[0], np.cumsum(a["parts"].astype(np.int64))])
        of, n = a["of"].astype(np.int64), len(a["n"])
        spread = np.repeat(np.unpackbits(a["spread"], count=len(of)).astype(bool), of)
        lowest = np.empty(n, np.float32)  # a word's count, or a finished bigram's negative logarithm
        lowest[~spread], lowest[spread] = LEVELS[a["level"]], _from_planes(a, "finished.") / CODES
        held = np.unpackbits(a["held"], count=n).astype(bool)
        number = lambda x: (v := _from_planes(a, x)).astype(np.uint32) if int(a[x + "width"][0]) <= 4 else v
        self.context, self.of, self.ends = _from_sorted_planes(a, "context."), of, np.concatenate([[0], np.cumsum(of)])
        self.columns = {"two": number("two."), "word": number("word."), "n": a["n"], "held": held, "spread": spread, "lowest": lowest}
        self.row, self.score = number("row."), np.empty(n, np.float32)

    def part(self, k: int) -> dict[str, np.ndarray]:
        from_, to = self.bounds[k : k + 2]
        mine = slice(*np.searchsorted(self.ends, [from_, to]))
        return {"context": np.repeat(self.context[mine], self.of[mine]), **{c: x[from_:to] for c, x in self.columns.items()}}

    def take(self, k: int, score: np.ndarray) -> None:
        self.score[self.bounds[k] : self.bounds[k + 1]] = score


def _log_probabilities(asked: list[dict[str, np.ndarray]], corpus: Corpus) -> np.ndarray:
    """The log10 probability of each trigram sent, times how often its row has it, in the order sent."""
    context, two, word, n, held, spread, lowest = (np.concatenate([a[c] for a in asked]) for c in ("context", "two", "word", "n", "held", "spread", "lowest"))
    n, lowest = n.astype(np.int64), lowest.astype(float)
    lowest[~spread], lowest[spread] = corpus.lowest(lowest[~spread]), 10.0 ** -lowest[spread]
    grams = [np.unique(x, return_inverse=True) for x in (context, two, word)]
    (_, c), (olds, e), (words, w) = grams
    if len(grams[0][0]) * len(olds) * len(words) < 1 << 63:
        order = np.argsort((c * len(olds) + e) * len(words) + w)
    else:
        order = np.lexsort((w, e, c))
    new = np.ones(len(order), bool)
    c1, e1, w1 = c[order], e[order], w[order]
    new[1:] = (c1[1:] != c1[:-1]) | (e1[1:] != e1[:-1]) | (w1[1:] != w1[:-1])
    which = np.cumsum(new) - 1
    first = order[new]
    count = np.bincount(which, np.where(held, 0, n)[order], len(first))
    seen = count > 0
    every = [(distinct, x[first]) for distinct, x in grams]
    # the levels are mapped from a scratch file of this task, which has no name and goes with it
    with tempfile.TemporaryFile() as file:
        NgramTrie.write(file, *(_used(distinct, x[seen]) for distinct, x in every), count[seen])
        with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as levels:
            trie = NgramTrie(unpack(levels))
            p = np.log10(trie.probability(*every, lowest[first], spread[first]))
            del trie
    each = np.empty(len(order))
    each[order] = p[which]
    return each * n


def _used(distinct: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values that are used, and the places among them."""
    used = np.bincount(which, minlength=len(distinct)) > 0
    return distinct[used], (np.cumsum(used) - 1)[which]


def _gather(table: pa.Table) -> pa.Table:
    """A block's rows: its facts, and its sums from all shards."""
    parts = [(is_fact, _expand(body)) for is_fact, body in zip(table.column("facts").to_pylist(), table.column("body").to_pylist())]
    a = next(x for is_fact, x in parts if is_fact)
    score = a["own"].copy()
    for is_fact, x in parts:
        if not is_fact:
            score[_from_sorted_planes(x).astype(np.int64)] += x["total"]
    cols = [pa.array(a["ids"], mask=a["known_id"] == 0), pa.array(a["held"].astype(bool)), *map(pa.array, (a["tokens"], a["known"], a["base"], score))]
    return pa.table(cols, [x.split()[0] for x in RESULT.split(", ")])


class Tables:
    """Tables in the shared folder that are bucketed by block, so that they meet without another shuffle."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.made = spark, buckets, {}

    def write(self, df: DataFrame, dealt: bool = True, *kinds: str) -> DataFrame:
        """``df`` as a table, partitioned by ``kinds``; with ``dealt`` each bucket is one file."""
        name, path = f"blocks_{uuid.uuid4().hex}", new_path(self.spark, "blocks")
        writer = (df.repartition(self.buckets, "block") if dealt else df).write
        writer = writer.partitionBy(*kinds) if kinds else writer
        writer.bucketBy(self.buckets, "block").option("path", path).option("compression", "none").saveAsTable(name)
        self.made[name] = path
        return self.spark.table(name)

    def drop(self) -> None:
        for name, path in self.made.items():
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, path)


def _replies(counts: DataFrame, name: str) -> DataFrame:
    return counts.groupBy("block").agg(F.collect_list(F.struct("shard", "body")).alias(name))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    The model learns from the rows where ``held_out`` is false (null counts as false) and scores all. Tokens are the words
    of the whole text, A-Z lowered, and one end. ``base_score`` is the unigram estimate with half a count added to each
    training type and to one unknown; ``score`` the trigram model's log10 probability, interpolated by absolute
    discounting down to that estimate. Stored values are quantised to 8 bits, and so are counts above 64 in the estimate that
    ``score`` falls back to. How contexts are dealt or spread changes nothing else.

    Null and empty texts are an end alone. Repeated rows and null ids are rows like others; with no training rows every score
    is the estimate of an empty table. An empty table gives no rows; other columns are ignored. The scores are computed at
    once and written to the shared folder; the tables in between are deleted.
    """
    spark = docs.sparkSession
    size = int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    word_shards = 1 + size // (12 * SHARD_WORDS)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    # with fewer buckets than shuffle partitions Spark would deal both sides of a join anew
    tables = Tables(spark, max(1 + size // (4 * BLOCK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    written = tables.write(rows.mapInArrow(_tokens(word_shards), "block long, shard int, body binary, kind string"), False, "kind")
    words = written.where("kind = 'words'").groupBy("shard")
    counts = tables.write(words.applyInArrow(_count, "block long, shard int, body binary, tokens long, types long, most long"))
    tokens, types, most = (x or 0 for x in counts.agg(F.sum("tokens"), F.sum("types"), F.max("most")).first())
    n_docs, shards = rows.where("not held_out").count(), 1 + size // (6 * PART_TOKENS * PARTS)
    limits = (max(x, tokens // MOST_SPREAD) for x in (SPREAD_TOKENS, SETTLED_TOKENS))
    corpus = Corpus(tokens, types, n_docs, word_shards, shards, shards, *limits)
    delete(spark, f"{next(iter(tables.made.values()))}/kind=words")
    free_shuffles(spark)

    streams = written.where("kind = 'stream'").select("block", "body").join(_replies(counts, "parts"), "block")
    most = max(most, n_docs)
    for size, replies, limit in ((1, "pairs", corpus.limit), (2, "triples", corpus.settled)):
        if most <= limit:  # no context of this size is spread
            break
        shared = spark.sparkContext.broadcast(corpus)
        asked = streams.mapInArrow(_grams(shared, size), "block long, shard int, body binary").groupBy("shard")
        grams = tables.write(asked.applyInArrow(_count_grams, GRAMS))
        most = max(grams.agg(F.max("most")).first()[0] or 0, n_docs)
        found = grams.where("context is not null").groupBy("context").agg(F.sum("successors").alias("n")).toArrow()
        contexts, n = (np.asarray(c.combine_chunks()) for c in (found.column("context"), found.column("n")))
        order = np.argsort(contexts.view(U64))
        corpus.successors.append((contexts.view(U64)[order], n[order]))
        streams = streams.join(_replies(grams.where("body is not null"), replies), "block", "left")
        free_shuffles(spark)
    shared = spark.sparkContext.broadcast(corpus)
    asked = streams.mapInArrow(_requests(shared), "block long, shard int, facts boolean, body binary")
    got = asked.groupBy("shard").applyInArrow(_score(shared), "block long, facts boolean, body binary")
    out = got.groupBy("block").applyInArrow(_gather, RESULT)
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
    out = materialize(out, "scores")
    tables.drop()
    return out
