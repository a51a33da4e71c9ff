"""Score arithmetic and decision rules on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_logit(p: Column, eps: float = 0.01) -> Column:
    """MTH1: ln(p / (1 - p)) with p kept within [eps, 1 - eps]; null for null."""
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))


def platt(p: Column, a: float, b: float) -> Column:
    """MTH1: the sigmoid of a * logit + b."""
    return 1 / (1 + F.exp(-(F.lit(a) * clipped_logit(p) + F.lit(b))))


def band_verdict(p: Column, width: float) -> Column:
    """MTH2: substantive outside 0.5 +- width; null is inconclusive."""
    return F.when(p >= 0.5 + width, "phishing").when(p <= 0.5 - width, "benign").otherwise("inconclusive")


def forced_verdict(verdict: Column, score: Column, default: str = "benign") -> tuple[Column, Column]:
    """MTH3: verdict and where it comes from: substantive, score or default."""
    known = verdict.isin("phishing", "benign")
    by_score = F.when(score >= 0.5, "phishing").otherwise("benign")
    out = F.when(known, verdict).when(score.isNotNull(), by_score).otherwise(default)
    return out, F.when(known, "substantive").when(score.isNotNull(), "score").otherwise("default")


def conclusion(enough_bad: Column, holds_bad: Column, enough_good: Column, holds_good: Column) -> Column:
    """MTH4: a side that has enough support and holds against its objections decides, if the other one does not; null is false."""
    no = F.lit(False)
    bad, good = (F.coalesce(a, no) & F.coalesce(b, no) for a, b in ((enough_bad, holds_bad), (enough_good, holds_good)))
    return F.when(bad & ~good, "phishing").when(good & ~bad, "benign").otherwise("insufficient")
