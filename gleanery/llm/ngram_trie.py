"""An Elias-Fano n-gram trie: monotone sequences in compact levels that can be memory-mapped, with quantised values.

The trie of one shard has contexts (the word before), their successors, longer contexts (the word before that) and their
successors. Children lie in ranges given by monotone pointers. A word is stored relative to its context: on the last
level as its place among the successors of the shorter context, which is a far smaller number than the word itself.
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
#: Numbers, or distinct numbers in order with places among them.
Keys = np.ndarray | tuple[np.ndarray, np.ndarray]
_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Ones in each byte value, and the place of its k-th one.
ONES = _bits.sum(1)
KTH = np.array([[*np.flatnonzero(b), *[0] * (8 - b.sum())] for b in _bits], np.int64)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One contiguous buffer: a header of names, types and lengths, then the arrays, 8-byte aligned."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    head += b" " * (-len(head) % 8)
    parts = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        raw = np.ascontiguousarray(a).tobytes()
        parts += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(parts)


def unpack(buffer) -> dict[str, np.ndarray]:
    """Views of the arrays in a buffer of :func:`pack`, without a copy; ``buffer`` may be a memory-mapped file."""
    view = np.frombuffer(buffer, np.uint8)
    size = int(view[:8].view(np.int64)[0])
    at, out = 8 + size, {}
    for name, kind, n in json.loads(bytes(view[8 : 8 + size])):
        width = np.dtype(kind).itemsize * n
        out[name] = view[at : at + width].view(kind)
        at += width + -width % 8
    return out


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(largest / length) bits each."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str) -> None:
        self.n, self.low_bits = (int(x) for x in arrays[prefix + "size"])
        self.low, self.high = arrays[prefix + "low"], arrays[prefix + "high"]
        # ones, and zeros, before each byte of the high bits; kept beside the mapped level, not in it
        self.ones = np.concatenate([[0], np.cumsum(ONES[self.high])]).astype(np.int64)
        self.zeros = np.arange(len(self.ones)) * 8 - self.ones

    @staticmethod
    def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, U64)
        at = np.arange(n) * bits
        part = (v & ((1 << bits) - 1)).astype(U64)
        shift = (at & 63).astype(U64)
        np.bitwise_or.at(low, at >> 6, part << shift)
        over = (at & 63) + bits > 64
        np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (U64(64) - shift[over]))
        set_at = (v >> bits) + np.arange(n)
        size = int(set_at[-1]) + 2 if n else 1
        high = np.zeros(-(-size // 64) * 64, np.uint8)
        high[set_at] = 1
        high = np.packbits(high, bitorder="little")
        return {prefix + "size": np.array([n, bits], np.int64), prefix + "low": low, prefix + "high": high}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        shift = (at & 63).astype(U64)
        word = self.low[at >> 6] >> shift
        over = shift > 0
        word = np.where(over, word | (self.low[(at >> 6) + 1] << ((U64(64) - shift) & U64(63))), word)
        return (word & U64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, of the high bits; one past the end where there is none."""
        before = self.zeros if zero else self.ones
        byte = np.minimum(np.searchsorted(before, k, "right") - 1, len(self.high) - 1)
        left = k - before[byte]
        bits = ~self.high[byte] if zero else self.high[byte]
        return np.where(left < 8, byte * 8 + KTH[bits, np.minimum(left, 7)], len(self.high) * 8)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i) << self.low_bits) | self._lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element of at least each ``x``, and whether it equals it."""
        high = x >> self.low_bits
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - high + 1, 0)
        stop = np.minimum(self._select(high, True) - high, self.n)
        start = np.minimum(start, stop)
        want = x & ((1 << self.low_bits) - 1)
        low, high = start, stop.copy()
        live = np.flatnonzero(low < high)
        while len(live):  # halve the elements that share the high part
            middle = (low[live] + high[live]) >> 1
            less = self._lows(middle) < want[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        found = low < stop
        at = np.flatnonzero(found)
        found[at] = self._lows(low[at]) == want[at]
        return low, found


def quantise(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Codes of 8 bits and their codebook: the distinct values if few, else the means of bins of equal width, so that no
    value is off by more than a 256th of the range."""
    book, code = np.unique(values, return_inverse=True)
    if len(book) > 256:
        width = (book[-1] - book[0]) / 256
        code = np.minimum(((values - book[0]) / width).astype(np.int64), 255)
        book = np.bincount(code, values, 256) / np.maximum(1, np.bincount(code, minlength=256))
    return {name + "code": code.astype(np.uint8), name + "book": book.astype(np.float32)}


class NgramTrie:
    """One shard: bigrams (context, word) and trigrams (context, earlier word, word), interpolated by absolute discounting."""

    DISCOUNT = 0.75

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.a = arrays
        self.contexts, self.earlier, self.words = (EliasFano(arrays, f"{x}.") for x in ("contexts", "earlier", "words"))
        self.two_ptr, self.two = EliasFano(arrays, "two_ptr."), EliasFano(arrays, "two.")
        self.ctx_ptr, self.ctx = EliasFano(arrays, "ctx_ptr."), EliasFano(arrays, "ctx.")
        self.three_ptr, self.three = EliasFano(arrays, "three_ptr."), EliasFano(arrays, "three.")

    @classmethod
    def write(cls, file, context: Keys, earlier: Keys, word: Keys, count: np.ndarray) -> None:
        """The levels as one buffer in an open file, to be mapped and read by :func:`unpack`."""
        file.write(pack(cls.levels(context, earlier, word, count)))
        file.flush()

    @classmethod
    def levels(cls, context: Keys, earlier: Keys, word: Keys, count: np.ndarray) -> dict[str, np.ndarray]:
        """From distinct trigrams and their counts; contexts and words are numbers below 2 ** 63, each as one array or as
        distinct values in order and each trigram's place among them."""
        (contexts, c), (olds, e), (words, w) = map(_distinct, (context, earlier, word))
        arrays = EliasFano.build(contexts, "contexts.") | EliasFano.build(olds, "earlier.") | EliasFano.build(words, "words.")
        two, first = np.unique(c * len(words) + w, return_inverse=True)
        n2 = np.bincount(first, count)
        of2 = two // max(1, len(words))
        arrays |= cls._level("two", of2, two % max(1, len(words)), len(contexts), n2)
        start2 = np.searchsorted(of2, np.arange(len(contexts)))
        ctx, second = np.unique(c * len(olds) + e, return_inverse=True)
        arrays |= cls._level("ctx", ctx // max(1, len(olds)), ctx % max(1, len(olds)), len(contexts), None)
        place = first - start2[c]  # of the word among the context's successors
        width = int(place.max(initial=0)) + 1
        order = np.argsort(second * width + place)
        return arrays | cls._level("three", second[order], place[order], len(ctx), count[order].astype(float))

    @classmethod
    def _level(cls, name: str, parent: np.ndarray, child: np.ndarray, parents: int, count: np.ndarray | None) -> dict[str, np.ndarray]:
        """Children sorted by parent and number: pointers, numbers above the range before, and quantised values."""
        start = np.searchsorted(parent, np.arange(parents + 1))
        last = child[np.maximum(start[1:] - 1, 0)] + 1 if len(child) else np.zeros(parents, np.int64)
        base = np.concatenate([[0], np.cumsum(np.where(np.diff(start) > 0, last, 0))])
        out = EliasFano.build(start, f"{name}_ptr.") | EliasFano.build(base[parent] + child + 1, f"{name}.")
        out |= EliasFano.build(base, f"{name}_base.")
        if count is not None:
            total, types = np.bincount(parent, count, parents), np.diff(start)
            out |= quantise(np.log10((count - cls.DISCOUNT) / total[parent]), f"{name}_p.")
            out |= quantise(np.log10(cls.DISCOUNT * types / np.maximum(total, 1)), f"{name}_b.")
        return out

    def _find(self, name: str, ptr: EliasFano, ids: EliasFano, parent: np.ndarray, child: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, ...]:
        """Index and place in its range of a child of each parent, and whether there is one."""
        at, place, hit = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64), np.zeros(len(parent), bool)
        some = np.flatnonzero(ok)
        if not ids.n or not len(some):
            return at, place, hit
        mine, child = parent[some], child[some]
        new = np.ones(len(mine), bool)  # questions come in the order of parents, mostly: each parent is read once
        new[1:] = mine[1:] != mine[:-1]
        once, of = mine[new], np.cumsum(new) - 1
        base = EliasFano(self.a, f"{name}_base.").get(once)[of]
        start, stop = ptr.get(once)[of], ptr.get(once + 1)[of]
        found, same = ids.successor(base + child + 1)
        good = same & (found >= start) & (found < stop)
        at[some[good]], place[some[good]], hit[some[good]] = found[good], (found - start)[good], True
        return at, place, hit

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        return 10.0 ** self.a[name + "book"][self.a[name + "code"][at]].astype(float)

    def probability(
        self, context: Keys, earlier: Keys, word: Keys, lowest: np.ndarray, finished: np.ndarray | None = None
    ) -> np.ndarray:
        """Of each word after its context, interpolated down to the ``lowest`` order's probability. Where ``finished`` is set,
        ``lowest`` is the bigram's probability already, counted elsewhere."""
        p = lowest.astype(float)
        if not self.contexts.n:
            return p
        c, known = _index(self.contexts, context)
        w, has_word = _index(self.words, word)
        at2, place, hit2 = self._find("two", self.two_ptr, self.two, c, w, known & has_word)
        add = np.ones(len(p), bool) if finished is None else ~finished
        p = np.where(known & add, self._value("two_b.", c) * p, p)
        p[hit2 & add] += self._value("two_p.", at2[hit2 & add])
        e, has_old = _index(self.earlier, earlier)
        ctx, _, known = self._find("ctx", self.ctx_ptr, self.ctx, c, e, known & has_old)
        at3, _, hit3 = self._find("three", self.three_ptr, self.three, ctx, place, known & hit2)
        p = np.where(known, self._value("three_b.", ctx) * p, p)
        p[hit3] += self._value("three_p.", at3[hit3])
        return p


def _distinct(keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    return keys if isinstance(keys, tuple) else np.unique(keys, return_inverse=True)


def _index(level: EliasFano, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys in a level of distinct numbers, and whether they are there; each distinct key is sought once."""
    distinct, which = _distinct(keys)
    at, ok = level.successor(distinct.astype(np.int64))
    return np.where(ok, at, 0)[which], ok[which]
