"""Rates with bootstrap intervals, and the comparison of experiment methods."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill import constants as C
from quizmill.functions import records as R


def with_intervals(rates: DataFrame, samples: int = C.BOOTSTRAP_SAMPLES) -> DataFrame:
    """Add value and 95% interval to rows of ``n, k, seed``.

    A resample of n yes/no values with k yes is one binomial draw, so the cost per rate does
    not depend on n.
    """
    if samples < C.BOOTSTRAP_MIN:
        raise ValueError(f"samples must be at least {C.BOOTSTRAP_MIN}")
    low_at = math.floor(0.025 * (samples - 1))
    high_at = math.ceil(0.975 * (samples - 1))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            low, high, value = [], [], []
            for n, k, seed in zip(rows["n"], rows["k"], rows["seed"]):
                point = k / n if n else None
                value.append(point)
                if n and n > 1:
                    drawn = np.sort(np.random.default_rng(int(seed)).binomial(n, k / n, samples)) / n
                    low.append(float(drawn[low_at]))
                    high.append(float(drawn[high_at]))
                else:
                    low.append(point)
                    high.append(point)
            yield rows.assign(
                value=pd.Series(value, index=rows.index, dtype="float64"),
                ci95_low=pd.Series(low, index=rows.index, dtype="float64"),
                ci95_high=pd.Series(high, index=rows.index, dtype="float64"),
            )

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rates.schema.fields]
    schema = ", ".join([*fields, "value double", "ci95_low double", "ci95_high double"])
    out = rates.mapInPandas(draw, schema)
    return out.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c in ("value", "ci95_low", "ci95_high")
    })


def judge_status(status: Column) -> Column:
    """Not run or absent: no value. Anything but a pass counts as a failure."""
    return F.when(status.isNotNull() & (status != "not_run"), status == "pass")


def internal_values(draft: Column, refs: Column, origin: Column, validation: Column) -> dict[str, Column]:
    values = {
        "record_yield": origin == "verified",
        "schema_valid_rate": R.schema_valid(draft),
        "evidence_reference_rate": F.coalesce(F.size(refs) > 0, F.lit(False)),
    }
    for name in C.JUDGE_FIELDS:
        values[name] = judge_status(validation[name])
    return values


def rates_by_method(df: DataFrame, values: dict[str, Column], group: str, first_seed: list[int]) -> DataFrame:
    """Long table (method, section, metric, n, k, offset) from one pass over the records."""
    cells = [
        c
        for name, value in values.items()
        for c in (F.count(value).alias(f"n_{name}"), F.count_if(value).alias(f"k_{name}"))
    ]
    wide = df.groupBy("method").agg(*cells)
    rows = F.array(*[
        F.struct(
            F.lit(group).alias("section"), F.lit(name).alias("metric"),
            F.col(f"n_{name}").alias("n"), F.col(f"k_{name}").alias("k"),
            F.lit(offset).alias("offset"),
        )
        for name, offset in zip(values, first_seed)
    ])
    return wide.select("method", F.explode(rows).alias("r")).select("method", "r.*")


def with_seeds(rates: DataFrame, seed: int = C.BOOTSTRAP_SEED) -> DataFrame:
    """Seeds by sorted method; the table has a few rows per method."""
    index = rates.select("method").distinct().withColumn(
        "i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("method")) - 1
    )
    return rates.join(index, "method").withColumn(
        "seed", F.lit(seed) + F.col("i") * 100 + F.col("offset")
    ).drop("i", "offset")


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Records per method and value of ``key``; missing counts as unknown."""
    return df.groupBy(
        "method", F.lit(key).alias("key"), F.coalesce(F.col(key), F.lit("unknown")).alias("value")
    ).agg(F.count(F.lit(1)).alias("records"))


def method_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(
        F.count_if(F.col("origin") == "verified").alias("n_verified"),
        F.count_if(F.col("origin") != "verified").alias("n_quarantine"),
        F.count(F.lit(1)).alias("n_completed"),
        F.count_if("audited").alias("n_expert_audited"),
    )


@F.pandas_udf(T.StringType())
def percent_text(value: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([
        "—" if pd.isna(v) else f"{v * 100:.1f}% [{a * 100:.1f}, {b * 100:.1f}]"
        for v, a, b in zip(value, low, high)
    ])


HEADER = [  # fixed table head
    "| Method | Completed | Record yield (95% CI) | Schema valid | Evidence refs | Expert pass |",
    "|---|---:|---:|---:|---:|---:|",
]


def markdown_table(metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """Report lines (line, text); one per method under the head."""
    shown = ["record_yield", "schema_valid_rate", "evidence_reference_rate", "overall_publishable"]
    wanted = metrics.where(F.col("metric").isin(shown)).withColumn(
        "text", percent_text("value", "ci95_low", "ci95_high")
    )
    wide = wanted.groupBy("method").pivot("metric", shown).agg(F.first("text"))
    joined = counts.join(wide, "method", "left")
    cells = F.concat_ws(
        " | ", F.col("method"), F.col("n_completed").cast("string"),
        *[F.coalesce(F.col(c), F.lit("—")) for c in shown],
    )
    body = joined.select(
        (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("method")) + 2).alias("line"),
        F.concat(F.lit("| "), cells, F.lit(" |")).alias("text"),
    )
    head = metrics.sparkSession.createDataFrame(list(enumerate(HEADER, 1)), "line int, text string")
    return head.unionByName(body)
