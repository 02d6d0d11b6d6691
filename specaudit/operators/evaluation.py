"""Scoring against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit.functions import geo, text

ABSTAINED = ("needs_context", "not_found", "ambiguous", "invalid_evidence")
FLAGS = ("citation_match", "standard_match", "edition_match", "value_match", "comparator_match", "applicability_match", "audit_decision_match", "overall_correct")


def abstains(status: Column) -> Column:
    return F.coalesce(status.isin(*ABSTAINED), F.lit(False))


def passage_matches(g: str, h: str, formed: bool = False) -> Column:
    """All locators that a case supplies hold for a hit; a case without locators matches nothing.  ``formed``: both sides have their match forms as ``__form``."""
    supplied = F.array(*(F.when(F.col(f"{g}.{c}").isNotNull(), F.lit(c)) for c in ("expected_evidence_id", "expected_content_hash", "expected_quote")))
    some = F.size(F.filter(supplied, lambda x: x.isNotNull())) > 0
    def held(a, b):
        return F.col(f"{g}.{a}").isNull() | F.coalesce(F.col(f"{g}.{a}") == F.col(f"{h}.{b}"), F.lit(False))

    said, wanted = (F.col(f"{h}.__form"), F.col(f"{g}.__form")) if formed else (text.match_form(F.col(f"{h}.text")), text.match_form(F.col(f"{g}.expected_quote")))
    quote = F.col(f"{g}.expected_quote").isNull() | F.coalesce(F.contains(said, wanted), F.lit(False))
    meta = held("expected_edition_year", "edition_year") & held("expected_page", "page") & (F.col(f"{g}.expected_standard_id").isNull() | F.coalesce(F.lower(f"{g}.expected_standard_id") == F.lower(f"{h}.standard_id"), F.lit(False)))
    return some & held("expected_evidence_id", "evidence_id") & held("expected_content_hash", "content_hash") & quote & meta


def first_matches(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """``case_id, first_rank``: rank of a case's first matching hit, null if there is none.

    A case looks at the hits of its ``request_id``, where it has one, else of its ``case_id``.  Cases that name a passage or its digest are joined on that as well, so only
    cases with nothing but a quote meet all hits of their request.
    """
    own = gold if "request_id" in gold.columns else gold.withColumn("request_id", F.col("case_id"))
    named, hashed = F.col("expected_evidence_id").isNotNull(), F.col("expected_content_hash").isNotNull()
    # a text's form is made once and not for each pair
    own = own.withColumn("__form", text.match_form(F.col("expected_quote")))
    h = hits.withColumn("__form", text.match_form(F.col("text"))).alias("h")
    same = F.col("g.request_id") == F.col("h.request_id")
    ways = [(named, same & (F.col("g.expected_evidence_id") == F.col("h.evidence_id"))), (~named & hashed, same & (F.col("g.expected_content_hash") == F.col("h.content_hash"))), (~named & ~hashed & F.col("expected_quote").isNotNull(), same)]
    found = [own.where(which).alias("g").join(h, on).where(passage_matches("g", "h", formed=True)).select("g.case_id", "h.rank") for which, on in ways]
    ranks = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    return gold.select("case_id").join(ranks, "case_id", "left")


def case_records(cases: DataFrame) -> DataFrame:
    """Hit and rank columns from ``first_rank``, and ``overall_correct`` over the flags that are known."""
    known = F.filter(F.array(*(F.col(c) for c in FLAGS[:-1])), lambda x: x.isNotNull())
    return (
        cases.withColumn("retrieval_hit_at_5", F.coalesce(F.col("first_rank") <= 5, F.lit(False))).withColumn("retrieval_hit_at_10", F.coalesce(F.col("first_rank") <= 10, F.lit(False)))
        .withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).withColumn("overall_correct", F.when(F.size(known) > 0, F.forall(known, lambda x: x)))
    )


def mean_flag(c: str) -> Column:
    """Share of true among known, four places; null if nothing is known."""
    return F.bround(F.avg(F.col(c).cast("int")), 4).alias(c.replace("_match", "_accuracy"))


def summarize(records: DataFrame) -> DataFrame:
    """One row: recalls, mean reciprocal rank, accuracies, abstention precision and recall."""
    e, p = F.coalesce("expected_abstention", F.lit(False)), F.coalesce("predicted_abstention", F.lit(False))
    both, said, due = (F.sum(x.cast("int")) for x in (e & p, p, e))
    return records.agg(
        F.count(F.lit(1)).alias("cases"), F.bround(F.avg(F.col("retrieval_hit_at_5").cast("int")), 4).alias("recall_at_5"), F.bround(F.avg(F.col("retrieval_hit_at_10").cast("int")), 4).alias("recall_at_10"),
        F.bround(F.avg("reciprocal_rank"), 4).alias("mrr"), *(mean_flag(c) for c in FLAGS),
        F.bround(both / F.nullif(said, F.lit(0)), 4).alias("abstention_precision"), F.bround(both / F.nullif(due, F.lit(0)), 4).alias("abstention_recall"),
    )


def latency(records: DataFrame, key: str = "metric_key", value: str = "total_latency_ms") -> DataFrame:
    """Count, mean, median and nearest-rank 95th percentile of each metric, three places."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(value), 3).alias("mean_ms"), F.bround(F.expr(f"median({value})"), 3).alias("median_ms"), F.bround(geo.nearest_rank(value, 0.95), 3).alias("p95_ms"))


def validate_gold(gold: DataFrame) -> DataFrame:
    """Cases that break the rules: a found case needs a value, a comparator and a locator of its passage."""
    located = F.coalesce("expected_evidence_id", "expected_content_hash", "expected_quote").isNotNull()
    return gold.where((F.col("expected_status") == "found") & (~located | F.col("expected_value_m").isNull() | F.col("expected_comparator").isNull()))
