"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets are one class from the start. Each class is posted under its signature's coordinate
and value pairs. Pairs held by one class only are dropped; classes with fewer shared pairs than the match threshold
are dropped (count filter); the others keep their rarest pairs, so many that any two classes with enough collisions
share a posting list (prefix filter).

A posting list is never paired with itself as a whole. Each list has a pivot, its most central member, and all members
are compared with it on the full sets. What that leaves open of the list is settled by what the comparison showed:
two members of different components can only be linked if their overlaps with the pivot and their sizes allow it
(those few pairs are compared), or if they share enough shingles that the pivot lacks (these make the posting lists of
the next round, under the same count and prefix filters, and far shorter). Rounds go on while any list is long. The pairs
still open then are candidates one by one: their collisions are counted over the coordinates of both signatures, pairs with
fewer than the match threshold are skipped, and those retained are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.texts import BASE, FOLD, SPACED, U64, blocks, hash_spans, mix, shingles, text_buffer, word_spans
from gleanery.operators.graph import component_stars
from gleanery.sources.shared import free_shuffles, materialize, release

COORDINATES = 64
#: The chance at most that a pair at the threshold has too few equal coordinates to be compared.
MISS = 5e-5
#: A list of more members than this takes another round, up to so many rounds; what is left after them is still compared.
LONG_LIST, MOST_ROUNDS = 256, 8
#: A missing id is the smallest.
NO_ID = -(2**63)
_rng = np.random.default_rng(64)
FACTORS = _rng.integers(0, 2**63, COORDINATES, dtype=U64) * U64(2) + U64(1)
SHIFTS = _rng.integers(0, 2**63, COORDINATES, dtype=U64)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row by row and ordered, and the rows' bounds. A text of fewer than ``k`` words, but not
    none, has one: its whole sequence of words."""
    data, offsets = text_buffer(column)
    data = FOLD[data]
    starts, ends, rows = word_spans(data, offsets, SPACED)
    words = hash_spans(data, starts, ends)
    h, of = shingles(words, rows, k)
    counts = np.bincount(rows, minlength=len(column))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = []
        for r in short:
            x = U64(0)
            with np.errstate(over="ignore"):
                for w in words[first[r] : first[r] + counts[r]]:
                    x = x * BASE + w
            extra.append(x)
        h, of = np.concatenate([h, mix(np.array(extra, U64))]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(column) + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows by coordinates: the smallest 32-bit value of each hash function over a set; zeros for empty sets."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    for j in range(COORDINATES if len(full) else 0):
        v = ((h * FACTORS[j] + SHIFTS[j]) >> U64(32)).astype(np.uint32)
        out[full, j] = np.minimum.reduceat(v, bounds[:-1][full])
    return out


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _posted(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The signatures as lists; a value carries its coordinate's number, so equal values are equal coordinates."""
    posted = signatures(h, bounds).astype(U64) | (np.arange(COORDINATES, dtype=U64) << U64(32))
    ends = np.arange(0, posted.size + 1, COORDINATES)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(posted.ravel()))


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 4 << 20):
            h, bounds = shingle_sets(b.column("text"), k)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(n), _signed(set_hash(h, bounds)), _posted(h, bounds)], ["doc_id", "row", "n_shingles", "class", "posted"]
            )

    return run


def set_hash(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set, of all its members and their number."""
    n = np.diff(bounds)
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(h + BASE), bounds[:-1][full]) + n[full].astype(U64))
    return out


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 4 << 20):
            h, bounds = shingle_sets(b.column("text"), k)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _signed(h))
            mine = np.asarray(b.column("class")) == set_hash(h, bounds).view(np.int64)
            out = [b.column("class"), pa.array(np.diff(bounds)), lists, _posted(h, bounds)]
            out = pa.RecordBatch.from_arrays(out, ["class", "n", "members", "posted"])
            yield out.filter(pa.array(mine))

    return run


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(p, q, both, n_p, n_q, extra)`` of class pairs: sizes, overlap, and what ``q`` has beyond ``p``."""
    one = sets.select(F.col("class").alias("p"), F.col("n").alias("n_p"), F.col("members").alias("of_p"))
    two = sets.select(F.col("class").alias("q"), F.col("n").alias("n_q"), F.col("members").alias("of_q"))
    extra = F.array_except("of_q", "of_p")
    return pairs.join(one, "p").join(two, "q").select("p", "q", "n_p", "n_q", extra.alias("extra")).withColumn("both", F.col("n_q") - F.size("extra"))


def _retained(pairs: DataFrame, signed: DataFrame, matches: int) -> DataFrame:
    """The class pairs with ``matches`` collisions or more: coordinates in which their signatures have one value."""
    posted = signed.groupBy("class").agg(F.min("posted").alias("posted"))
    one, two = (posted.select(F.col("class").alias(c), F.col("posted").alias(f"of_{c}")) for c in ("p", "q"))
    counted = pairs.join(one, "p").join(two, "q").withColumn("collisions", F.size(F.array_intersect("of_p", "of_q")))
    return counted.where(F.col("collisions") >= matches).select("p", "q")


def _linked(percent: int):
    return 100 * F.col("both") >= percent * (F.col("n_p") + F.col("n_q") - F.col("both"))


def least_matches(percent: int, miss: float = MISS) -> int:
    """The most equal coordinates that can be asked of a pair whose similarity is ``percent`` / 100, so that it has fewer with a
    chance of ``miss`` at most (binomial); 1 at least."""
    p, below = percent / 100, 0.0
    for m in range(COORDINATES):
        below += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if below > miss:
            return max(1, m)
    return COORDINATES


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, matches: int | None = None, rounds: int = 2, row: str | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Two documents are linked if their sets of ``k``-word shingles have a Jaccard similarity of ``percent`` / 100 or more,
    confirmed on the full sets; ``component_id`` is the smallest ``doc_id`` reachable over links and ``kept`` marks the
    document that has it. Pairs are compared if ``matches`` of 64 coordinates are equal, by default :func:`least_matches` of
    ``percent``: 42 at 85, where a pair at the threshold has fewer with a chance of 3.0e-5, and 38 at 80, where it is 4.4e-5;
    links more similar than that are found all the more surely. At least ``rounds`` rounds shorten the posting lists.

    Null texts and texts without words have an empty set and no links: their component is their own id. Rows with the same
    ``doc_id`` are rows of one component if their sets are linked, else of several. Ids are integers; a null id is the
    smallest, and a component named by it has a null name. An empty
    table gives no rows; other columns are ignored.

    ``row`` names a column of unique integers, the same at each reading. It is then a column of the result too, and ``kept``
    marks one row of each component, of those with its id the one with the smallest ``row``; rows with an empty set are all kept.
    """
    matches = least_matches(percent) if matches is None else matches
    number = F.lit(0).cast("long") if row is None else F.col(row).cast("long")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), number.alias("row"), F.col("text").cast("string").alias("text"))
    signed = texts.mapInArrow(_sign(k), "doc_id long, row long, n_shingles long, class long, posted array<long>")
    signed, spark = materialize(signed, "signed"), docs.sparkSession
    full = signed.where("n_shingles > 0")

    classes = full.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("posted").alias("posted"))
    posted = classes.select("class", F.explode("posted").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(shared, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    shared = shared.where(F.size("keys") >= matches)
    central = F.aggregate("keys", F.lit(0).cast("long"), lambda n, x: n + x["df"]).alias("central")
    prefix = F.slice(F.col("keys.key"), F.lit(1), F.size("keys") - matches + 1).alias("keys")
    kept = materialize(shared.select("class", central, prefix), "lists")
    lists = kept.select(F.explode("keys").alias("key"), F.col("class").alias("q"), "central")

    free_shuffles(spark)  # what is shuffled and written on the way goes as soon as nothing reads it again, not when the driver happens to collect its garbage
    named = "doc_id" if row is None else "row"
    picked = full.join(kept.select("class"), "class").groupBy("class").agg(F.min(named).alias(named))
    sets = texts.join(picked, named).select("class", "text").mapInArrow(_sets(k), "class long, n long, members array<long>, posted array<long>")
    # rows that share an id may have one set; a row's own number names one row, and its set is sent nowhere
    sets = materialize(sets.dropDuplicates(["class"]) if row is None else sets, "sets")
    rows = materialize(signed.select("doc_id", "row", "n_shingles", "class"), "numbered")
    release(signed)
    free_shuffles(spark)
    full, empty, before = rows.where("n_shingles > 0"), rows.where("n_shingles = 0"), kept

    links = loose = parts = None  # links confirmed after the first round; pairs that sizes and overlaps leave open; components of the first round
    for turn in range(MOST_ROUNDS):
        size = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max_by("q", F.struct("central", "q")).alias("p"))
        entries = materialize(lists.join(size.where("size > 1").drop("size"), "key").select("key", "p", "q"), "entries")
        release(before)
        free_shuffles(spark)
        # the pivot itself is one of the members compared with it, and linked
        written = materialize(_compare(entries.select("p", "q").distinct(), sets), "compared")
        free_shuffles(spark)
        compared = written.withColumn("linked", _linked(percent))
        new = materialize(compared.where("linked and p <> q").select("p", "q"), "links")
        if parts is None:
            parts = component_stars(new, "p", "q").select(F.col("node").alias("class"), F.col("component").alias("part"))
        else:
            links = new if links is None else links.unionByName(new)
        # a member linked to the pivot stands in its component
        judged = compared.select("p", "q", "n_q", "both", F.when(F.col("linked"), F.col("p")).otherwise(F.col("q")).alias("stand"))
        known = entries.join(_placed(judged, parts, "stand"), ["p", "q"])
        mixed = known.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key")
        known = materialize(known.join(mixed, "key"), "known")
        release(entries)
        free_shuffles(spark)
        found = _open_pairs(known, percent)
        loose = found if loose is None else loose.unionByName(found)
        later = known.groupBy("p", "q").agg(F.min("part").alias("part")).join(compared.select("p", "q", "n_q", "both", "extra"), ["p", "q"])
        need = F.greatest(F.lit(1), F.ceil(F.col("n_q") * percent / 100) - F.col("both")).cast("int")
        later = later.select("p", "q", "part", need.alias("need"), "both", F.explode("extra").alias("x"))
        later = later.withColumn("key", F.xxhash64("p", "x")).drop("x")
        several = later.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b")
        later = later.join(several.select("key", "df"), "key").groupBy("p", "q", "part", "need", "both")
        later = later.agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys")).where("size(keys) >= need")
        prefix = F.explode(F.slice("keys", F.lit(1), F.size("keys") - F.col("need") + 1)).alias("x")
        lists = later.select(prefix, "q", "part", F.col("both").alias("central"))
        lists = before = materialize(lists.select(F.col("x.key").alias("key"), "q", "part", "central"), "lists")
        release(written)
        free_shuffles(spark)
        if turn + 1 >= rounds and lists.groupBy("key").count().where(F.col("count") > LONG_LIST).isEmpty():
            break
    rest = lists.select("key", "q", "part")
    rest = rest.alias("a").join(rest.alias("b"), "key").where("a.q < b.q and a.part <> b.part").select(F.col("a.q").alias("p"), F.col("b.q").alias("q"))
    left = loose.unionByName(rest).distinct()
    new = _compare(_retained(left, sets, matches), sets).where(_linked(percent)).select("p", "q")
    links = new if links is None else links.unionByName(new)
    # only what still connects components of the first round goes through rounds again
    links = _placed(_placed(links, parts, "p").withColumnRenamed("part", "a"), parts, "q").withColumnRenamed("part", "b")
    wider = component_stars(links, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("part"))

    of = full.select("doc_id", "row", "n_shingles", "class")
    of = _placed(_placed(of, parts, "class").withColumnRenamed("part", "class"), wider, "class")
    least = of.groupBy("part").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    out = of.join(least, "part").select("doc_id", "row", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
    out = out.unionByName(empty.select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
    out = out.withColumn("kept", (F.col("doc_id") == F.col("component_id")) & F.col("kept"))
    out = out.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc_id", "component_id")})
    return out.drop("row") if row is None else out.withColumnRenamed("row", row)


def _placed(rows: DataFrame, parts: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``part`` in place of ``column``: the component of its class, or the class itself where ``parts`` has none."""
    at = parts.withColumnRenamed("class", column)
    return rows.join(at, column, "left").withColumn("part", F.coalesce("part", column)).drop(column)


def _open_pairs(known: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list and different components whose similarity may reach the threshold even if all they share is in
    the pivot: at most the smaller overlap with it. Only sizes within the threshold's ratio are brought together. A pair comes
    once for each list that it shares."""
    step = F.floor(F.log(F.col("n_q").cast("double")) / F.log(F.lit(100.0 / percent)))
    side = known.select("key", "q", "n_q", "both", "part", step.alias("step"))
    left = side.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    a, b = left.alias("a"), side.alias("b")
    most = F.least(F.col("a.both"), F.col("b.both"))
    may = 100 * most >= percent * (F.col("a.n_q") + F.col("b.n_q") - most)
    # sizes of one step meet once, by order of class; those of neighbouring steps once, from the lower step
    once = (F.floor(F.log(F.col("a.n_q").cast("double")) / F.log(F.lit(100.0 / percent))) < F.col("b.step")) | (F.col("a.q") < F.col("b.q"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.part") != F.col("b.part")) & may & once
    return a.join(b, on).select(F.least("a.q", "b.q").alias("p"), F.greatest("a.q", "b.q").alias("q"))
