"""Judge reports of an item brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill import constants as C
from quizmill.functions import records as R
from quizmill.functions import text as X

FIELDS = ["judge", "passed", "issues", "feedback", "blocking"]


def fan_in(reports: DataFrame, item: str, order: str, judges: list[str] | None = None) -> DataFrame:
    """One row per item with its reports: an array in judge order and a map by judge.

    Each judge keeps its latest report. All of it is one partial aggregation, so an item with
    very many report rows is reduced before the shuffle.
    """
    judges = judges or ["generation", *C.JUDGES]
    have = [c for c in FIELDS if c in reports.columns]
    row = F.struct(*[F.col(c) for c in have])
    latest = [
        F.max_by(F.when(F.col("judge") == j, row), F.when(F.col("judge") == j, F.col(order))).alias(f"_{j}")
        for j in judges
    ]
    merged = reports.groupBy(item).agg(*latest)
    ordered = F.array_compact(F.array(*[F.col(f"_{j}") for j in judges]))
    return merged.select(
        item,
        ordered.alias("report_list"),
        F.map_from_entries(
            F.transform(ordered, lambda r: F.struct(r["judge"].alias("key"), r.alias("value")))
        ).alias("reports"),
    )


def cue_report(
    selected: Column, answer: Column, confidence: Column, difficulty: Column,
    cue_type: Column, cue_text: Column, error: Column,
) -> Column:
    """Solver report: fails on a concrete cue in a confidently solved hard item."""
    found = R.cue_found(selected, answer, confidence, difficulty, cue_type, cue_text)
    broken = error.isNotNull()
    return F.struct(
        F.lit("adversarial_solver").alias("judge"),
        (~broken & ~found).alias("passed"),
        F.when(broken, F.array(F.concat(F.lit("solver_error:"), error)))
        .when(found, F.array(F.lit("adversarial:spurious_cues_found")))
        .otherwise(R.empty())
        .alias("issues"),
        F.when(
            ~broken & found,
            F.concat(
                F.lit("A concrete "), cue_type, F.lit(" cue was named: "), X.strip(cue_text),
                F.lit(". Rebalance the options."),
            ),
        ).otherwise(F.lit("")).alias("feedback"),
        (~broken & found & cue_type.isin(C.BLOCKING_CUES)).alias("blocking"),
    )


def baseline_accept(df: DataFrame) -> DataFrame:
    """Controls: every draft is published; without one the generation issues are the reason."""
    failed = F.col("draft").isNull()
    reasons = F.coalesce("generation_issues", F.array(F.lit("missing_mcq")))
    return df.withColumn("reasons", F.when(failed, reasons).otherwise(R.empty())).withColumn(
        "verdict", R.verdict(F.col("reasons"))
    )


def unreported(reasons: Column, report_list: Column) -> Column:
    """Gate reasons that no failed report has named; repeats are kept."""
    seen = F.coalesce(R.named_issues(report_list, skip_warnings=False), R.empty())
    return F.filter(reasons, lambda x: ~F.array_contains(seen, x))
