"""Exact cosine similarity of weighted term rows at scale: pairs above a threshold, and the nearest of each row.

Rows are ``(key, term, w)``, weights not negative and each key's of unit length. For pairs a key's terms are ordered from the rarest to
the most frequent. What two keys share is then found at their first shared term, and all that follows it is bounded by what is
left of either row; so only postings from which the bound still reaches the threshold are joined, and a term that stands in every
row is no one's first unless the row has little else. For the nearest, blocks of keys meet as matrices.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.texts import shingle_terms
from gleanery.sources.shared import free_shuffles, materialize, release

#: Bounds give way by so much, so that rounding loses no pair at the threshold.
SLACK = 1e-9
#: Keys of a block, about; postings of two blocks that a term must multiply to be a column of a matrix.
MEMBERS, DENSE = 2048, 2_000
#: Rows of a group that are compared in one place.
TOGETHER = 256


def unit_rows(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """``(key, term, w)``: counts over the length of their vector."""
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    return counts.join(norm, key).select(key, "term", (F.col(value) / F.col("_norm")).alias("w"))


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``df``, the number of keys of a term, and ``left``, the length of what follows the term in its row, rare terms first."""
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    later = Window.partitionBy(key).orderBy(F.col("df").desc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sqrt(F.coalesce(F.sum(F.col("w") * F.col("w")).over(later), F.lit(0.0)))
    return rows.join(df, "term").withColumn("left", left)


def _packed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A row's terms as a map; its size is the row's own."""
    entries = F.map_from_entries(F.collect_list(F.struct("term", "w")))
    return rows.groupBy(F.col(key).alias(name)).agg(entries.alias(f"_{name}"))


def _dot(a: Column, b: Column) -> Column:
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: x * y))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def exact_cosine(pairs: DataFrame, rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Adds ``cosine`` to pairs of keys."""
    both = pairs.join(_packed(rows, key, a), a).join(_packed(rows, key, b), b)
    return both.withColumn("cosine", _dot(F.col(f"_{a}"), F.col(f"_{b}"))).drop(f"_{a}", f"_{b}")


def candidate_pairs(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """Pairs ``a < b`` that share a term from which both rows' rests multiply to the threshold or more: all pairs at or above it, and few
    others. Postings below the threshold leave their row before the join."""
    tail = F.sqrt(F.col("w") * F.col("w") + F.col("left") * F.col("left"))
    prefix = _ranked(rows, key).withColumn("tail", tail).where(F.col("tail") >= threshold - SLACK)
    one = prefix.select(F.col(key).alias("a"), "term", F.col("w").alias("w_a"), F.col("left").alias("left_a"))
    two = prefix.select(F.col(key).alias("b"), "term", F.col("w").alias("w_b"), F.col("left").alias("left_b"))
    reach = F.col("w_a") * F.col("w_b") + F.col("left_a") * F.col("left_b")
    return one.join(two, "term").where("a < b").where(reach >= threshold - SLACK).select("a", "b").distinct()


def similar_pairs(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """JOIN10, TXT7: ``(a, b, cosine)`` of all pairs with a cosine of ``threshold`` (above 0) or more, ``a < b``; a key without terms is in
    none. To compare within groups only, make the group a part of the term."""
    rows = materialize(rows.select(key, "term", "w"), "weights")
    found = exact_cosine(candidate_pairs(rows, key, threshold), rows, key, "a", "b")
    return found.where(F.col("cosine") >= threshold - 1e-12).select("a", "b", "cosine")


def similar_within(docs: DataFrame, group: str, key: str, text: str, threshold: float) -> DataFrame:
    """GRA4, EVD17: ``(a, b, cosine)`` of the pairs ``a < b`` of a group whose counts of words, word bigrams and runs of four characters have a
    cosine of ``threshold`` (above 0) or more. ``text`` has a row's words with one space between. Groups of up to ``TOGETHER`` rows are compared in
    one place, so no term becomes a row; larger ones by the terms they share, as :func:`similar_pairs`. Rows of one key count as one."""
    rows = docs.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(group, key, text)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.where(F.col("_n") > TOGETHER).select(group), "large")
    kind = rows.schema[key].dataType.simpleString()

    def compare(batch: pa.Table) -> pa.Table:
        return cosines_within(batch[key], batch[text], threshold)

    out = rows.join(large, group, "left_anti").groupBy(group).applyInArrow(compare, f"a {kind}, b {kind}, cosine double")
    if not large.count():
        return out
    counts = shingle_terms(rows.join(large, group, "left_semi"), [group, key], text)
    inside = unit_rows(counts.withColumn("term", F.concat_ws("|", F.col(group), "term")), key)  # no pairs across groups
    return out.unionByName(similar_pairs(inside, key, threshold))


def cosines_within(keys: pa.ChunkedArray, texts: pa.ChunkedArray, threshold: float) -> pa.Table:
    """All pairs of a few texts at the threshold or above."""
    counts: dict = {}
    for key, s in zip(keys.to_pylist(), texts.to_pylist()):
        words = s.split(" ") if s else []
        mine = counts.setdefault(key, (Counter(), Counter(), Counter()))
        for kind, terms in zip(mine, (words, zip(words, words[1:]), (s[i : i + 4] for i in range(len(s) - 3)))):
            kind.update(terms)
    norms = {k: math.sqrt(sum(n * n for kind in c for n in kind.values())) for k, c in counts.items()}
    found = []
    for a, b in combinations(sorted(k for k in counts if norms[k]), 2):
        dot = 0
        for x, y in zip(counts[a], counts[b]):
            few, many = (x, y) if len(x) < len(y) else (y, x)
            dot += sum(few[t] * many[t] for t in few.keys() & many.keys())
        cosine = dot / (norms[a] * norms[b])
        if cosine >= threshold - 1e-12:
            found.append((a, b, cosine))
    one, two, cosine = zip(*found) if found else ((), (), ())
    return pa.table({"a": pa.array(one, keys.type), "b": pa.array(two, keys.type), "cosine": pa.array(cosine, pa.float64())})


def nearest(rows: DataFrame, key: str, groups: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """MLD14: ``(q, o, s, place)``: for each key the ``k`` others of greatest cosine ``s`` (rounded; above 0), not of its own group, ties to the
    larger key. ``groups`` has ``(key, grp)``; a null group is no one's own.

    Keys are dealt to blocks of about ``MEMBERS``, their terms told apart by 64-bit hashes, and each two blocks meet in a task of its own that
    reads both from the shared folder, so nothing is sent but the ``k`` best of each block for each key. Work grows with the square of the
    keys, a task does not."""
    rows = materialize(rows.select(key, "term", "w"), "weights")
    blocks = max(1, -(-rows.select(key).distinct().count() // MEMBERS))
    of = groups.select(key, F.when(F.col("grp").isNotNull(), F.xxhash64("grp")).alias("grp")).distinct()
    dealt = rows.join(of, key, "left").select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"), "grp", F.xxhash64("term").alias("term"), "w")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"block int, key array<{kind}>, grp array<long>, row array<int>, term array<long>, w array<double>"
    packed = materialize(dealt.repartitionByRange(blocks, "block").groupBy("block").applyInArrow(packed_block, schema), "blocks")
    release(rows)
    free_shuffles(rows.sparkSession)
    one, two = (packed.select(*(F.col(c).alias(f"{x}_{c}") for c in packed.columns)) for x in "ab")
    met = one.join(two.hint("shuffle_replicate_nl"), F.col("a_block") <= F.col("b_block"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = ({c: batch.column(f"{x}_{c}")[i] for c in packed_columns} for x in "ab")
                yield from meeting(a, b, k, digits)

    packed_columns = packed.columns
    found = met.mapInArrow(best, f"q {kind}, o {kind}, s double")
    order = Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("o").desc())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def packed_block(postings: pa.Table) -> pa.Table:
    """A block in one row: its members (``key`` and ``grp``, in the order of keys) and their postings (``row`` is the member's place) by term."""
    postings = postings.combine_chunks()
    members = postings.group_by(["key", "grp"]).aggregate([]).sort_by([("key", "ascending"), ("grp", "ascending")])
    members = members.append_column("row", pa.array(np.arange(len(members), dtype=np.int32)))
    full = members.set_column(members.column_names.index("grp"), "grp", pc.fill_null(members["grp"], 0)).append_column("none", pc.is_null(members["grp"]))
    mine = postings.set_column(postings.column_names.index("grp"), "grp", pc.fill_null(postings["grp"], 0)).append_column("none", pc.is_null(postings["grp"]))
    placed = mine.join(full, ["key", "grp", "none"]).sort_by([("term", "ascending"), ("row", "ascending")])
    lists = {"key": members["key"], "grp": members["grp"], "row": placed["row"], "term": placed["term"], "w": placed["w"]}
    arrays = {c: x.combine_chunks() for c, x in lists.items()}
    return pa.table({"block": pa.array([postings["block"][0].as_py()], pa.int32()), **{c: pa.ListArray.from_arrays([0, len(x)], x) for c, x in arrays.items()}})


def meeting(a: dict, b: dict, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """``(q, o, s)``: the ``k`` nearest in either block of each member of the other. Terms that many of both have are multiplied as a matrix, the
    others posting by posting."""
    (keys_a, own_a, row_a, term_a, w_a), (keys_b, own_b, row_b, term_b, w_b) = ([x[c].values for c in ("key", "grp", "row", "term", "w")] for x in (a, b))
    row_a, term_a, w_a, row_b, term_b, w_b = (x.to_numpy() for x in (row_a, term_a, w_a, row_b, term_b, w_b))
    s = np.zeros((len(keys_a), len(keys_b)))
    terms, at_a, at_b = np.intersect1d(term_a, term_b, return_indices=True)  # of each term the first posting
    to_a, to_b = np.searchsorted(term_a, terms, "right"), np.searchsorted(term_b, terms, "right")
    dense = (to_a - at_a) * (to_b - at_b) > DENSE
    wide = []
    for row, w, at, to, n in ((row_a, w_a, at_a, to_a, len(keys_a)), (row_b, w_b, at_b, to_b, len(keys_b))):
        m = np.zeros((n, int(dense.sum())))
        for i, (x, y) in enumerate(zip(at[dense], to[dense])):
            m[row[x:y], i] = w[x:y]
        wide.append(m)
    np.matmul(wide[0], wide[1].T, out=s)
    for x, y, u, v in zip(at_a[~dense].tolist(), to_a[~dense].tolist(), at_b[~dense].tolist(), to_b[~dense].tolist()):
        s[row_a[x:y, None], row_b[u:v]] += w_a[x:y, None] * w_b[u:v]
    np.round(s, digits, out=s)
    grp_a, grp_b = (pc.fill_null(x, 0).to_numpy() for x in (own_a, own_b))
    apart = (grp_a[:, None] != grp_b) | own_a.is_null().to_numpy(zero_copy_only=False)[:, None] | own_b.is_null().to_numpy(zero_copy_only=False)
    s[~apart] = 0
    same = a["block"].as_py() == b["block"].as_py()
    if same:
        place = pc.index_in(keys_a, pc.unique(keys_a)).to_numpy()
        s[place[:, None] == place] = 0
    for scores, q, o in ((s, keys_a, keys_b),) if same else ((s, keys_a, keys_b), (s.T, keys_b, keys_a)):
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(len(scores))
        i, j = np.nonzero((scores >= least[:, None]) & (scores > 0))
        order = np.lexsort((-j, -scores[i, j], i))  # keys are in order, so the larger place is the larger key
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        yield pa.RecordBatch.from_arrays([q.take(pa.array(i)), o.take(pa.array(j)), pa.array(scores[i, j])], ["q", "o", "s"])


def nearest_label_features(near: DataFrame, labels: DataFrame, key: str, with_vector: DataFrame) -> DataFrame:
    """MLD14: a row per key of ``labels`` ``(key, y)``: the weighted share of label 1 among its nearest (a half without any), the greatest
    similarity by class (0 without any), and whether it has no vector."""
    met = near.join(labels.select(F.col(key).alias("o"), "y"), "o")
    best = [F.max(F.when(F.col("y") == c, F.col("s"))).alias(n) for c, n in ((1, "good"), (0, "bad"))]
    found = met.groupBy(F.col("q").alias(key)).agg((F.sum(F.col("s") * F.col("y")) / F.sum("s")).alias("share"), *best)
    has = with_vector.select(key).distinct().withColumn("_has", F.lit(True))
    out = labels.select(key).join(found, key, "left").join(has, key, "left").fillna({"share": 0.5, "good": 0.0, "bad": 0.0})
    return out.select(key, "share", "good", "bad", F.col("_has").isNull().alias("no_vector"))
