"""The inverted join at a similarity of 0.8: no link at the threshold is left out by the coordinates asked for."""

import math
import random

from gleanery.llm import near_dedup as N


def test_matches_keep_the_miss_chance():
    def below(m, percent):
        return sum(math.comb(64, i) * (percent / 100) ** i * (1 - percent / 100) ** (64 - i) for i in range(m))

    assert N.least_matches(85) == 42 and N.least_matches(80) == 38 and N.least_matches(100) == 64 and N.least_matches(1) == 1
    for percent in range(20, 100):
        m = N.least_matches(percent)
        assert below(m, percent) <= N.MISS < below(m + 1, percent)


def test_pairs_at_the_threshold_are_found(spark):
    """Pairs of 90 shingles each that share 80: 80 of 100. Asked for 42 equal coordinates, some of these would stay apart."""
    r, rows, few = random.Random(5), [], []
    for i in range(1500):
        a = [f"p{i}w{j}" for j in range(94)]
        b = [*a[:84], *(f"p{i}x{j}" for j in range(10))]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in N.near_duplicates(df, percent=80).collect()}
    few = [i for i in range(1500) if got[2 * i + 1] != 2 * i]
    assert len(got) == 3000 and not few
