"""Paired statistics of two systems on the same cases."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.metrics import PHISHING
from gleanery.sources.shared import materialize


def pair(df: DataFrame, one: str, two: str) -> DataFrame:
    """JOIN2: cases that both arms decided, with the label and both verdicts."""
    a, b = (df.where(F.col("arm") == x) for x in (one, two))
    return a.select("case_id", "label", F.col("verdict").alias("one")).join(b.select("case_id", F.col("verdict").alias("two")), "case_id")


def discordant(pairs: DataFrame) -> DataFrame:
    """Cases that one arm alone gets right, in one row."""
    a, b = F.col("one") == F.col("label"), F.col("two") == F.col("label")
    return pairs.agg(F.count_if(a & ~b).alias("only_one"), F.count_if(~a & b).alias("only_two"))


def mcnemar(b: Column, c: Column) -> Column:
    """STA7: the exact two-sided binomial tail; 1 without discordant pairs.

    Terms are summed from the largest down, each from the one before by their ratio. Below it they fall off within a few
    square roots of n, so six of those (and fifty terms) hold all that a double can tell; the largest term itself comes from
    the logarithmic gamma series."""
    n, k = (b + c).cast("double"), F.least(b, c)
    last = F.greatest(F.lit(0), k - F.ceil(6 * F.sqrt(n)) - 50).cast("long")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1) - n * F.log(F.lit(2.0)))
    start = F.struct(top.alias("term"), top.alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    below = F.when(k > last, F.sequence(k.cast("long"), last + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(below, start, step)["sum"]))


def _log_gamma(x: Column) -> Column:
    """For x of at least 1, to about 1e-12: Stirling's series eight places up."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for i in range(8):
        series = series - F.log(x + i)
    return series


#: Cases whose kinds are sent to all tasks at most, four bytes each; more meet their draws by shuffle. Cases of a row that is sent.
BROADCAST_CASES, PACKED = 8_000_000, 65_536
#: Tasks that share the resamples. Hashes that are taken together: what they need stays in a core's cache.
RESAMPLE_TASKS, TOGETHER = 48, 16_384


def resample(cases: DataFrame, resamples: int) -> DataFrame:
    """Cases drawn with replacement: ``b``, the columns of ``cases`` but ``case_id``, and ``k``, how often a case with these values
    is in resample ``b``. Draw j of a resample is a quarter of the hash of b and j div 4, modulo the number of cases, which
    are numbered by a two-level count. Cases that are alike are of one kind; each task has the kinds of all cases by their numbers, makes
    the draws of some resamples and counts them by kind, so no draw becomes a row."""
    numbered = materialize(number_rows(cases, "case_id").drop("case_id"), "cases")
    columns, n = [c for c in numbered.columns if c != "no"], numbered.count()
    spark = cases.sparkSession
    if n > BROADCAST_CASES:
        return _joined_draws(numbered, n, resamples)
    kinds = numbered.groupBy(*columns).agg(F.min("no").alias("_kind"))  # a kind's number is its first case's
    alike = F.lit(True)
    for c in columns:
        alike = alike & F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}"))
    of = numbered.alias("c").join(kinds.alias("k"), alike).select("no", F.col("_kind").cast("int"))
    packed = of.groupBy(F.expr(f"no div {PACKED}").alias("start")).agg(F.array_sort(F.collect_list(F.struct("no", "_kind")))["_kind"].alias("kinds"))
    tasks = min(resamples, RESAMPLE_TASKS)
    shares = spark.range(tasks, numPartitions=tasks).withColumnRenamed("id", "task").crossJoin(F.broadcast(packed))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            for task, start, kinds in zip(*(batch.column(c) for c in ("task", "start", "kinds"))):
                parts.setdefault(task.as_py(), {})[start.as_py()] = kinds.values.to_numpy()
        for task, blocks in parts.items():
            names, table = np.unique(np.concatenate([blocks[i] for i in sorted(blocks)]), return_inverse=True)
            table = table.astype(np.min_scalar_type(len(names)))
            for b, drawn in kinds_drawn(range(task * resamples // tasks, (task + 1) * resamples // tasks), table):
                k = np.bincount(drawn, minlength=len(names))
                hit = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), b)), pa.array(names[hit].astype(np.int64)), pa.array(k[hit])], ["b", "_kind", "k"])

    times = shares.mapInArrow(draw, "b long, _kind long, k long")
    return times.join(kinds, "_kind").select("b", *columns, "k")


def kinds_drawn(resamples: Iterable[int], table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each resample with the kinds of its draws; ``table`` has the kind of each case by its number."""
    n = len(table)
    groups = (n + 3) // 4
    drawn, tails, width, quotient = np.empty((groups, 4), table.dtype), [], 0, np.empty(TOGETHER, np.uint32)
    for b in resamples:
        head = f"{b}|".encode()
        if len(head) != width:
            width, tails = len(head), list(numbers_after(len(head), groups))
        for at, words in tails:
            for i, x in enumerate(md5_words(head, words)):
                q = np.floor_divide(x.byteswap(inplace=True), np.uint32(n), out=quotient[: len(x)])  # with multiplying, faster than a remainder
                drawn[at : at + len(x), i] = table[np.subtract(x, np.multiply(q, np.uint32(n), out=q), out=x)]
        yield b, drawn.reshape(-1)[:n]


def numbers_after(width: int, count: int) -> Iterator[tuple[int, list]]:
    """Numbers from 0 to below ``count`` as the ends of hashed texts whose first ``width`` bytes are the same: the first number of each
    stretch of equal length, and the sixteen words of a block with the digits and the padding; words that all share are single numbers."""
    low, digits = 0, 1
    while low < count:
        high = min(low + TOGETHER, 10**digits, count)
        at, words = np.arange(low, high), [0] * 14 + [8 * (width + digits), 0]
        for i in range(digits):
            byte = width + i
            digit = (at // 10 ** (digits - 1 - i) % 10 + 48).astype(np.uint32) << np.uint32(8 * (byte % 4))
            words[byte // 4] = words[byte // 4] + digit
        end = width + digits
        words[end // 4] = words[end // 4] + np.uint32(0x80 << 8 * (end % 4))
        yield low, words
        low = high
        digits += low == 10**digits


SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def md5_words(head: bytes, words: list) -> list[np.ndarray]:
    """The four words of the MD5 hashes of many short texts that begin with ``head``, the rest given by ``words``: one block each."""
    words = [w + int.from_bytes(head[4 * i : 4 * i + 4], "little") if 4 * i < len(head) else w for i, w in enumerate(words)]
    words = [w if isinstance(w, np.ndarray) else int(w) for w in words]
    count = next(len(w) for w in words if isinstance(w, np.ndarray))
    first = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(count, x, np.uint32) for x in first)
    t, u = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=t), out=t), out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=t), out=t), out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(d, np.bitwise_xor(b, c, out=t), out=t)
        else:
            g = 7 * i % 16
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=t), out=t), out=t)
        np.add(t, a, out=t)
        if isinstance(words[g], np.ndarray):
            np.add(np.add(t, words[g], out=t), np.uint32(SINES[i]), out=t)
        else:
            np.add(t, np.uint32((SINES[i] + words[g]) % 2**32), out=t)
        np.left_shift(t, np.uint32(SHIFTS[i]), out=u)
        np.right_shift(t, np.uint32(32 - SHIFTS[i]), out=t)
        np.add(np.bitwise_or(t, u, out=t), b, out=a)
        a, b, c, d = d, a, b, c
    return [np.add(x, np.uint32(y), out=x) for x, y in zip((a, b, c, d), first)]


def _joined_draws(numbered: DataFrame, n: int, resamples: int) -> DataFrame:
    """The same for more cases than a task holds: each draw is a row and meets its case by shuffle."""
    columns = [c for c in numbered.columns if c != "no"]
    spark = numbered.sparkSession
    per = max(n - 1, 0) // 4 + 1
    groups = spark.range(resamples * per, numPartitions=max(1, min(resamples, spark.sparkContext.defaultParallelism * 4)))
    groups = groups.select(F.expr(f"id div {per}").alias("b"), (F.col("id") % per).alias("g"))
    parts = [F.struct((F.col("g") * 4 + i).alias("j"), F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long").alias("x")) for i in range(4)]
    draws = groups.withColumn("h", F.md5(F.concat_ws("|", "b", "g"))).select("b", F.inline(F.array(*parts))).where(F.col("j") < n)
    draws = draws.select("b", (F.col("x") % max(n, 1)).alias("no"))
    times = draws.groupBy("b", "no").agg(F.count(F.lit(1)).alias("k"))
    times = times.hint("merge")  # the plan takes the draws for as few as the resamples, and would broadcast them
    return times.join(numbered, "no").groupBy("b", *columns).agg(F.sum("k").alias("k"))


def class_draws(classes: DataFrame, n: str, resamples: int, stream: str, rows: int = 50_000) -> DataFrame:
    """Cases drawn with replacement, class by class: ``b``, the columns of ``classes`` but ``n``, and ``k``, how often cases of the class are in
    resample ``b`` (0 is left out). ``classes`` has a row for each kind of case and how many there are, so a resample costs as much
    as there are kinds, whatever the number of cases.

    The draws of a resample are split over buckets of classes, and each bucket's over its classes, by multinomial counts, which
    together have the law of single draws. Their seeds are the stream, the resample and the bucket, so reruns agree and streams are
    independent. ``rows`` classes are held by a task, about."""
    names = [c for c in classes.columns if c != n]
    kept = classes.where(F.col(n) > 0)
    buckets = max(16, -(-kept.count() // rows))
    dealt = kept.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    sizes = [0] * buckets
    for r in dealt.groupBy("_bucket").agg(F.sum(n).alias("s")).collect():  # a row per bucket
        sizes[r[0]] = int(r.s)
    shares, total, base = [s / max(sum(sizes), 1) for s in sizes], sum(sizes), zlib.crc32(stream.encode())

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        table = table.sort_by([(c, "ascending") for c in names])
        own = table.column(n).to_numpy()
        own, at, of, times = own / own.sum(), [], [], []
        for b in range(resamples):
            mine = np.random.default_rng([base, b]).multinomial(total, shares)[bucket]
            k = np.random.default_rng([base, b, bucket]).multinomial(mine, own)
            hit = np.flatnonzero(k)
            at.append(np.full(len(hit), b))
            of.append(hit)
            times.append(k[hit])
        out = table.select(names).take(pa.array(np.concatenate(of)))
        return out.append_column("b", pa.array(np.concatenate(at), pa.int64())).append_column("k", pa.array(np.concatenate(times), pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema if f.name != n)
    return dealt.groupBy("_bucket").applyInArrow(draw, f"{schema}, b long, k long")


def weighted_f1(verdict: str) -> Column:
    """Forced F1 of a column of verdicts over rows that count ``k`` times."""
    bad, hit = F.col("label") == PHISHING, F.col(verdict) == PHISHING

    def count(when: Column) -> Column:
        return F.sum(F.when(when, F.col("k")).otherwise(0))

    tp, fp, fn = count(bad & hit), count(~bad & (F.col(verdict) != F.col("label"))), count(bad & ~hit)
    return F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double"))


def bootstrap_f1(pairs: DataFrame, resamples: int) -> DataFrame:
    """STA1: per resample, the difference in forced F1 of two systems on the same cases."""
    t = resample(pairs.select("case_id", "label", "one", "two"), resamples)
    return t.groupBy("b").agg((weighted_f1("two") - weighted_f1("one")).alias("delta"))


def spread(deltas: DataFrame, value: str) -> DataFrame:
    """STA4, STA5: interval by the index rule, mean, and number of resamples."""
    mean = deltas.agg(F.avg(value).alias("mean"), F.count(value).alias("resamples"))
    return interval(deltas, value).select("low", "high").crossJoin(F.broadcast(mean))  # one row each


def adopt(candidates: DataFrame, reference: str, gain: float, loss: float, tie: float) -> DataFrame:
    """STA9: eligible candidates gain F1 on the reference and lose no more precision than ``loss``; of those within ``tie`` of the
    best, the cheapest is chosen (then by name), and the reference where none is eligible. Candidates are a handful."""
    ref = candidates.where(F.col("name") == reference).select(F.col("f1").alias("f0"), F.col("precision").alias("p0"))
    ok = (F.col("name") != reference) & (F.col("f1") >= F.col("f0") + gain) & (F.col("precision") >= F.col("p0") - loss)
    t = candidates.crossJoin(F.broadcast(ref)).withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("f0", "p0")
    best = t.agg(F.max(F.when(F.col("eligible"), F.col("f1"))).alias("best"))
    t = t.crossJoin(F.broadcast(best)).withColumn("tied", F.col("eligible") & F.coalesce(F.col("f1") >= F.col("best") - tie, F.lit(False))).drop("best")
    winner = t.agg(F.coalesce(F.min_by("name", F.when(F.col("tied"), F.struct("cost", "name"))), F.lit(reference)).alias("winner"))
    return t.crossJoin(F.broadcast(winner)).withColumn("chosen", F.col("name") == F.col("winner")).drop("winner")


def number_rows(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """``no`` from 0 in the order of bucket and key, without ordering all rows in one task. Keys are unique."""
    t = df.withColumn("_bucket", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("long") % buckets)
    counts = t.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return t.join(starts, "_bucket").withColumn("no", F.col("_start") + inside).drop("_bucket", "_start")


def interval(deltas: DataFrame, value: str = "delta", level: float = 0.95) -> DataFrame:
    """The index rule: sorted[int(.025 n)] and sorted[int(.975 n) - 1], with the two-sided p (STA6), over resamples."""
    tail = (1 - level) / 2
    i = F.row_number().over(Window.orderBy(value))
    n = deltas.where(F.col(value).isNotNull()).count()
    lo, hi = int(tail * n + 1e-9), max(0, int((1 - tail) * n + 1e-9) - 1)
    ranked = deltas.where(F.col(value).isNotNull()).withColumn("i", i - 1)
    return ranked.agg(
        F.max(F.when(F.col("i") == lo, F.col(value))).alias("low"),
        F.max(F.when(F.col("i") == hi, F.col(value))).alias("high"),
        (2 * F.least(F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double")))).alias("p"),
    )


def flips(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """STA11: verdict changes from the first arm to the second, and which of the two was right."""
    return pairs.where("one <> two").groupBy(*by, "one", "two").agg(
        F.count(F.lit(1)).alias("flips"),
        F.count_if(F.col("one") == F.col("label")).alias("first_right"),
        F.count_if(F.col("two") == F.col("label")).alias("second_right"),
    )


def component_helps(delta: Column, high: Column, least: float = 0.03) -> Column:
    """STA10: leaving the component out costs at least ``least``, and the interval of that lies below zero."""
    return F.coalesce((delta <= -least) & (high < 0), F.lit(False))


def go_no_go(runs: DataFrame, reference: str, precision: float = 0.01, coverage: float = 0.05) -> DataFrame:
    """STA12: candidates against a reference run, each criterion a column, and whether all hold."""
    ref = F.broadcast(runs.where(F.col("arm") == reference).select(*(F.col(c).alias(f"_{c}") for c in ("n", "f1", "precision", "coverage"))))  # one row
    j = runs.where(F.col("arm") != reference).crossJoin(ref)
    c = F.col
    tests = {
        "f1_holds": c("f1") >= c("_f1"), "precision_holds": c("precision") >= c("_precision") - precision, "coverage_holds": c("coverage") >= c("_coverage") - coverage,
        "complete": c("n") == c("_n"),
    }
    every = F.lit(True)
    for t in tests.values():
        every = every & t
    return j.select("arm", (c("f1") - c("_f1")).alias("delta"), *(t.alias(n) for n, t in tests.items()), every.alias("go"))


def rechosen_rates(draws: DataFrame, recall: float) -> DataFrame:
    """STA2: per resample ``b`` of ``(b, label, score, k)``, the highest score at which the recall is met, and the false positive rate there."""
    bad = F.col("label") == PHISHING
    t = draws.groupBy("b", "score").agg(F.sum(F.when(bad, F.col("k")).otherwise(0)).alias("pos"), F.sum(F.when(~bad, F.col("k")).otherwise(0)).alias("neg"))
    down, every = Window.partitionBy("b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("b")
    t = t.select("b", "score", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    return t.where(F.col("tp") >= F.ceil(F.col("p") * recall - 1e-9)).groupBy("b").agg(F.max("score").alias("threshold"), F.min(F.try_divide("fp", "n")).alias("fpr"))
