"""Evidence scoring: source grades, confidence, estimative language, competing hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the grades A-F and 1-6.
RELIABILITY = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "E": 0.1, "F": 0.5}
CREDIBILITY = {1: 1.0, 2: 0.8, 3: 0.6, 4: 0.4, 5: 0.1, 6: 0.5}
#: Upper bounds and terms of the probability bands.
BANDS = [(0.05, "almost no chance"), (0.20, "very unlikely"), (0.45, "unlikely"), (0.55, "roughly even chance"), (0.80, "likely"), (0.95, "very likely")]


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def admiralty_weight(reliability: str = "source_reliability", credibility: str = "info_credibility") -> Column:
    return F.round(F.sqrt(_lookup(RELIABILITY, F.col(reliability)) * _lookup(CREDIBILITY, F.col(credibility))), 4)


def admiralty_code(reliability: str = "source_reliability", credibility: str = "info_credibility") -> Column:
    return F.concat(F.col(reliability), F.col(credibility).cast("string"))


def effective_reliability() -> Column:
    """The grades' weight where both are set, else the reliability score."""
    return F.coalesce(admiralty_weight(), F.col("reliability_score"))


def confidence(evidence: DataFrame, key: str, tau: float = 1.0, graded: bool = False) -> DataFrame:
    """One row per key: score, support and contradiction mass, counts, is_contradicted, source_count (all rows).

    Only verified evidence weighs in. Partial sums run before the shuffle on the key.
    """
    weight = F.least(F.greatest(effective_reliability() if graded else F.col("reliability_score"), F.lit(0.0)), F.lit(1.0))
    counted = F.col("verification_status") == "verified"
    mass = lambda stance: F.coalesce(F.sum(F.when(counted & (F.col("stance") == stance), weight)), F.lit(0.0))
    number = lambda stance: F.count_if(counted & (F.col("stance") == stance))
    sums = evidence.where(F.col(key).isNotNull()).groupBy(key).agg(
        mass("supports").alias("s"), mass("contradicts").alias("c"), number("supports").alias("supports"), number("contradicts").alias("contradicts"), number("neutral").alias("neutral"), F.count("*").alias("source_count")
    )
    total = F.col("s") + F.col("c")
    score = F.when(total > 0, F.col("s") / total * (1 - F.exp(-total / tau))).otherwise(0.0)
    return sums.select(key, F.round(score, 4).alias("score"), F.round("s", 4).alias("support_mass"), F.round("c", 4).alias("contradict_mass"), "supports", "contradicts", "neutral", (F.col("contradicts") > 0).alias("is_contradicted"), "source_count")


def estimative_label(score: str) -> Column:
    out = F.lit("almost certain")
    for bound, label in reversed(BANDS):
        out = F.when(F.col(score) < bound, label).otherwise(out)
    return out


def analytic_confidence(support: str = "support_mass", contradict: str = "contradict_mass", contradicted: str = "is_contradicted") -> Column:
    mass = F.col(support) + F.col(contradict)
    return F.when((mass >= 2.5) & ~F.col(contradicted), "high").when(mass >= 1, "moderate").otherwise("low")


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """The last rating of each cell."""
    return ratings.groupBy("analysis_id", "hypothesis_id", "item_id").agg(F.max_by("consistency", "rev").alias("consistency"))


def ach_hypotheses(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Hypotheses of all analyses ranked by least inconsistency, then most consistent items."""
    cells = latest_ratings(ratings).join(items, ["analysis_id", "item_id"])
    n = lambda v: F.count_if(F.col("consistency") == v)
    penalty = F.when(F.col("consistency") == "inconsistent", 2 * F.col("weight")).when(F.col("consistency") == "neutral", 0.5 * F.col("weight")).otherwise(0.0)
    scored = cells.groupBy("analysis_id", "hypothesis_id").agg(F.round(F.sum(penalty), 4).alias("inconsistency"), n("consistent").alias("consistent"), n("inconsistent").alias("inconsistent"), n("neutral").alias("neutral"), n("na").alias("na"))
    rank = F.row_number().over(W.partitionBy("analysis_id").orderBy("inconsistency", F.desc("consistent"), "hypothesis_id"))
    return scored.withColumn("rank", rank).withColumn("most_likely", F.col("rank") == 1)


def ach_diagnosticity(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """weight * (1 - largest share of one value); 0 with at most one rating."""
    counts = latest_ratings(ratings).groupBy("analysis_id", "item_id", "consistency").agg(F.count("*").alias("n"))
    shares = counts.groupBy("analysis_id", "item_id").agg(F.sum("n").alias("ratings"), F.max("n").alias("top"))
    return shares.join(items, ["analysis_id", "item_id"]).select("analysis_id", "item_id", "ratings", F.when(F.col("ratings") <= 1, 0.0).otherwise(F.round(F.col("weight") * (1 - F.col("top") / F.col("ratings")), 4)).alias("diagnosticity"))
