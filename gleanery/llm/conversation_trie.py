"""The prefix trie of conversations, by burst tries.

A conversation is cut into suffixes of at most ``CUT`` turns, so one of any length stays a set of small rows. Each suffix belongs to
the container of its head, the trie node at which it begins; equal suffixes of a container are one row with a count. A container
with too many rows bursts: its suffixes' first turns become nodes of the trie, and each is the head of a new container of what
is left. Containers that no longer burst are dealt to shards, sorted, and swept once into nodes: neighbours in sorted order
share a prefix, and a node is done when the sweep leaves it.

What lies under a node can go on in other containers. So a first sweep only adds up each container; those sums are added along
the tree of containers by doubling steps, in as many rounds as the logarithm of its depth; a second sweep then gives the
nodes, with the sums of the containers that hang on them.

Turns are named by 64-bit hashes with their place, and a node by the exclusive or of its turns' names (two differ in name but with
a chance of about 1e-19).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.shared import materialize, release

CUT, CONTAINER, SHARD_TURNS = 64, 4096, 30_000
#: So many oversized containers' heads at most are broadcast (16 bytes each).
BROADCAST_HEADS = 100_000
ROOT = 0
NOTHING = hashlib.sha256(b"").hexdigest()


def number_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, turn_id, n_bytes)``: turns from 1 in the order of ``turn`` (null first; ties by role, then by a hash of the
    text, so reruns agree). Null roles and texts are empty; rows without a ``conv_id`` belong to none. Rows are numbered over a global
    order, so a conversation that holds a third of all rows is not one task's."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = rows.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("_role"), F.xxhash64(role, text).alias("turn_id"), F.octet_length(text).alias("n_bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "_role", "turn_id"]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed.drop("turn", "_role"), "turns")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))  # a row per partition
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_no", F.col("_start") + F.col("_id").bitwiseAND(2**33 - 1))
    first = numbered.groupBy("conv_id").agg(F.min("_no").alias("_first"))
    return numbered.join(first, "conv_id").select("conv_id", (F.col("_no") - F.col("_first") + 1).alias("place"), "turn_id", "n_bytes")


def _suffixes(turns: DataFrame) -> DataFrame:
    """Pieces of conversations: ``(conv_id, piece, head, end, z, b, more)``."""
    named = turns.select("conv_id", "place", F.xxhash64("turn_id", "place").alias("z"), F.col("n_bytes").alias("b"), F.expr(f"(place - 1) div {CUT}").alias("piece"))
    lists = F.array_sort(F.collect_list(F.struct("place", "z", "b")))  # so many turns at most
    pieces = named.groupBy("conv_id", "piece").agg(lists.alias("t"), F.bit_xor("z").alias("own"))
    w = Window.partitionBy("conv_id").orderBy("piece")
    end = F.bit_xor("own").over(w.rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("end", end).withColumn("more", F.lead("piece").over(w).isNotNull())
    return pieces.select("conv_id", "piece", F.col("end").bitwiseXOR(F.col("own")).alias("head"), "end", F.col("t.z").alias("z"), F.col("t.b").alias("b"), "more")


def _burst(suffixes: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows of containers of ``most`` suffixes at most, the nodes that bursting made ``(node, head, depth, n, conv, b)``, and the
    tables behind them."""
    settled, nodes, tables = [], [], []
    while True:
        suffixes = materialize(suffixes, "suffixes")
        tables.append(suffixes)
        big = suffixes.groupBy("head").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select("head")
        big = materialize(big, "heads")
        tables.append(big)
        found = big.count()
        if not found:
            return _union([*settled, suffixes]), _union(nodes) if nodes else _no_nodes(suffixes), tables
        few = F.broadcast(big) if found <= BROADCAST_HEADS else big
        settled.append(suffixes.join(few, "head", "left_anti"))
        moved = suffixes.join(few, "head", "left_semi").withColumn("node", F.col("head").bitwiseXOR(F.col("z")[0])).withColumn("depth", F.col("depth") + 1)
        grouped = moved.groupBy("node").agg(F.first("head").alias("head"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.first(F.col("b")[0]).alias("b"))
        nodes.append(materialize(grouped, "nodes"))
        tables.append(nodes[-1])
        rest = moved.where(F.size("z") > 1)
        suffixes = rest.select(F.col("node").alias("head"), "depth", *(F.slice(c, 2, CUT).alias(c) for c in ("z", "b")), "n", "conv", "more", "end")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _no_nodes(suffixes: DataFrame) -> DataFrame:
    return suffixes.select(F.col("end").alias("node"), "head", "depth", "n", "conv", F.lit(0).alias("b")).where("false")


def sweep(rows: list[tuple]) -> list[list]:
    """Nodes of one container from its suffixes ``(z, b, n, conv, more, leaves, saved, tops)``; those with ``more`` go on in a container
    whose sums they bring. A node is ``[depth, name, parent's index or -1, n, conv, children, leaves, saved]``, its depth and name
    relative to the head; children come after their parent."""
    nodes: list[list] = []
    path: list[int] = []
    sizes: list[int] = []
    last: list[int] = []

    def leave(depth: int) -> None:
        while len(path) > depth:
            node = nodes[path.pop()]
            node[6] += node[5] == 0
            node[7] += (node[3] - 1) * sizes.pop()
            if path:
                above = nodes[path[-1]]
                above[3] += node[3]
                above[4] = min(above[4], node[4])
                above[5] += 1
                above[6] += node[6]
                above[7] += node[7]

    for z, b, n, conv, more, leaves, saved, tops in sorted(rows, key=lambda r: r[0]):
        same = 0
        while same < len(path) and same < len(z) and z[same] == last[same]:
            same += 1
        leave(same)
        for at in range(same, len(z)):
            name = (nodes[path[-1]][1] if path else 0) ^ z[at]
            nodes.append([at + 1, name, path[-1] if path else -1, 0, conv, 0, 0, 0])
            path.append(len(nodes) - 1)
            sizes.append(b[at])
        node = nodes[path[-1]]
        node[3] += n
        node[4] = min(node[4], conv)
        if more:
            node[5] += tops
            node[6] += leaves
            node[7] += saved
        last = z
    leave(0)
    return nodes


def _containers(table: pa.Table) -> Iterator[tuple[int, list[dict]]]:
    rows = sorted(table.to_pylist(), key=lambda r: r["head"])
    for head, mine in itertools.groupby(rows, key=lambda r: r["head"]):
        yield head, list(mine)


def _sums(key: tuple, table: pa.Table) -> pa.Table:
    out = []
    for head, rows in _containers(table):
        # what goes on elsewhere is a child for now, so no leaf, and counts there
        nodes = sweep([(r["z"], r["b"], r["n"], r["conv"], r["more"], 0, 0, 1) for r in rows])
        top = [n for n in nodes if n[2] < 0]
        out.append((head, sum(n[6] for n in top), sum(n[7] for n in top), len(top)))
    return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("head", "leaves", "saved", "tops"))})


_NODE = "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _nodes(key: tuple, table: pa.Table) -> pa.Table:
    out: list[tuple] = []
    for head, rows in _containers(table):
        nodes = sweep([(r["z"], r["b"], r["n"], r["conv"], r["more"], r["leaves"], r["saved"], r["tops"]) for r in rows])
        depth, above = rows[0]["depth"], rows[0]["head_conv"]
        out += [(head ^ n[1], n[4], depth + n[0], nodes[n[2]][4] if n[2] >= 0 else above, n[3], n[5], n[6], n[7]) for n in nodes]
    names = [c.split()[0] for c in _NODE.split(", ")]
    return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(names)})


def _add_up(own: DataFrame) -> DataFrame:
    """``(head, leaves, saved)`` over each container and all below it, of ``(head, up, leaves, saved)``, ``up`` null at the root. After
    round k a row has the sums of the containers less than 2 ** k below it, and ``up`` is the one 2 ** k above."""
    now = materialize(own.select("head", "up", "leaves", "saved"), "sums")
    while now.where("up is not null").limit(1).count():
        below = now.where("up is not null").groupBy(F.col("up").alias("head")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        above = now.select(F.col("head").alias("up"), F.col("up").alias("_up"))
        after = now.join(below, "head", "left").join(above, "up", "left")
        after = after.select("head", F.col("_up").alias("up"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
        after = materialize(after, "sums")
        release(now)
        now = after
    return now.drop("up")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, comma-joined, from rows in the order of node and id; a node's rows may span batches."""
    at, digest = None, None
    for batch in batches:
        nodes, ids = batch.column("node").to_numpy(), batch.column("conv_id").to_pylist()
        done = ([], [])
        edges = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
        for a, b in itertools.pairwise(edges):
            if a == b:
                continue
            text = ",".join(map(str, ids[a:b])).encode()
            if at is not None and nodes[a] == at:
                digest.update(b"," + text)
            else:
                if at is not None:
                    done[0].append(at)
                    done[1].append(digest.hexdigest())
                at, digest = int(nodes[a]), hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], ["node", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per distinct sequence of first turns of any conversation, the textless root included.

    ``turns`` has ``(conv_id, place, turn_id, n_bytes)``, places from 1 without gaps; ``conversations`` has every ``conv_id`` once,
    those without turns too. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256``. No conversations give no rows. The ids
    of conversations that end at one node are digested in order as a stream of one task, as SHA-256 has it; only its state is held.
    """
    pieces = materialize(_suffixes(turns), "pieces")
    whole = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).where("n > 0")  # one row
    grouped = pieces.groupBy("piece", "head", "end").agg(
        F.first("z").alias("z"), F.first("b").alias("b"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.max("more").alias("more")
    )
    suffixes = grouped.select("head", (F.col("piece") * CUT).alias("depth"), "z", "b", "n", "conv", "more", "end")
    settled, burst, tables = _burst(suffixes, container)

    total = settled.agg(F.sum(F.size("z"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("head"), F.lit(max(1, math.ceil(total / SHARD_TURNS))))
    sums = settled.withColumn("shard", shard).groupBy("shard").applyInArrow(_sums, "head long, leaves long, saved long, tops long")
    # a burst head's nodes: those that are heads themselves have their leaves below
    heads = sums.select("head").unionByName(burst.select("head")).distinct()
    leaf = burst.join(heads.select(F.col("head").alias("node"), F.lit(1).alias("_inner")), "node", "left")
    own_leaf = F.when(F.col("_inner").isNull(), 1).otherwise(0)
    above = leaf.groupBy("head").agg(F.sum(own_leaf).cast("long").alias("leaves"), F.sum((F.col("n") - 1) * F.col("b")).cast("long").alias("saved"), F.count(F.lit(1)).alias("tops"))
    lies = burst.select(F.col("node").alias("head"), F.col("head").alias("up"), F.col("conv").alias("head_conv"))
    lies = lies.unionByName(settled.where("more").select(F.col("end").alias("head"), F.col("head").alias("up"), F.col("conv").alias("head_conv")))
    lies = lies.unionByName(whole.select(F.lit(ROOT).cast("long").alias("head"), F.lit(None).cast("long").alias("up"), F.col("conv").alias("head_conv")))
    own = materialize(sums.unionByName(above).join(lies, "head"), "containers")
    totals = _add_up(own).join(own.select("head", "tops", "head_conv"), "head")
    totals = materialize(totals, "totals")

    hung = totals.select(F.col("head").alias("end"), "leaves", "saved", "tops").withColumn("more", F.lit(True))
    swept = settled.join(hung, ["end", "more"], "left").join(totals.select("head", "head_conv"), "head").withColumn("shard", shard)
    nodes = swept.groupBy("shard").applyInArrow(_nodes, _NODE)
    under = totals.select(F.col("head").alias("node"), "leaves", "saved", "tops")
    leaves, saved, tops = F.coalesce("leaves", F.lit(1)), F.coalesce("saved", F.lit(0)), F.coalesce("tops", F.lit(0))
    parents = totals.select("head", F.col("head_conv").alias("parent_conv_id"))
    inner = burst.join(under, "node", "left").join(parents, "head").select(
        "node", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), tops.alias("n_children"), leaves.alias("n_leaves"),
        ((F.col("n") - 1) * F.col("b") + saved).alias("saved_tokens"),
    )
    root = whole.withColumn("node", F.lit(ROOT).cast("long")).join(under, "node", "left").select(
        "node", F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        tops.alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"),
    )
    ended = pieces.where("not more").select("conv_id", F.col("end").alias("node"))
    turnless = conversations.join(pieces.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(ROOT).cast("long").alias("node"))
    digests = ended.unionByName(turnless).select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_digests, "node long, ends_sha256 string")
    out = nodes.unionByName(inner).unionByName(root).join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    out = materialize(out.drop("node"), "trie")
    for t in (pieces, own, totals, *tables):
        release(t)
    return out
