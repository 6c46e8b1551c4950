"""Append-only ledgers of trials and of looks at the holdout, as tables in a folder that Spark reads and writes.

A ledger has one writer at a time: what is known is read before new rows are appended.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.plans.panel import HoldoutViolation, Splits

# The columns of both ledgers.
TRIALS = "trial_id string, timestamp_utc string, family string, variant string, params_json string, universe string, data_source string, data_range string, split string, cost_mult double, n_periods long, n_trades long, cagr double, sharpe_ann double, sr_period double, skew double, kurt double, max_dd double, bench_sharpe double, rationale string, status string, notes string"
LOOKS = "timestamp_utc string, strategy_id string, params_json string, splits string, data_source string, holdout_first string, holdout_last string, reason string"
#: The split by which variants are selected, and how many trials a variance needs.
SELECTION, LEAST = "DEV+VAL", 3


def trial_id(family: str, variant: str, params: dict, universe: str) -> str:
    """A short hash of what was tried; the same parameters in another order are the same trial."""
    return hashlib.sha1(json.dumps([family, variant, params, universe], sort_keys=True).encode()).hexdigest()[:10]


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger, empty if nothing was written yet."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True)


def unlogged(new: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of new (columns of TRIALS) that known doesn't hold, by trial, split, cost multiple and range; of several, the first."""
    key = ["trial_id", "split", "cost_mult", "data_range"]
    w = Window.partitionBy(*key).orderBy("timestamp_utc", *[c for c in new.columns if c not in (*key, "timestamp_utc")])
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(known.select(*key), key, "left_anti").select(*new.columns)


def log_trials(new: DataFrame, path: str) -> int:
    """Append the trials that the ledger doesn't hold; how many there were."""
    seen = Observation()
    known = load(new.sparkSession, path, TRIALS)
    unlogged(new, known).observe(seen, F.count("*").alias("n")).write.mode("append").csv(path, header=True)
    return seen.get["n"]


def tested(trials: DataFrame) -> DataFrame:
    return trials.where("status = 'tested'")


def n_trials(trials: DataFrame) -> DataFrame:
    return tested(trials).agg(F.countDistinct("trial_id").alias("n"))


def selected(trials: DataFrame, split: str = SELECTION) -> DataFrame:
    """Each tested trial's first row on the selection split, as logged."""
    w = Window.partitionBy("trial_id").orderBy("timestamp_utc", "cost_mult")
    return tested(trials).where(F.col("split") == split).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sr_variance(trials: DataFrame, split: str = SELECTION) -> DataFrame:
    """Variance of the trials' ratios on the selection split, whatever their cost multiple; NULL for fewer than LEAST trials."""
    return selected(trials, split).agg(F.when(F.count("sr_period") >= LEAST, F.var_samp("sr_period")).alias("variance"))


def trial_srs(trials: DataFrame, split: str = SELECTION) -> DataFrame:
    """Each trial's ratio on the selection split at plain costs."""
    return selected(trials.where("cost_mult = 1"), split).where("sr_period IS NOT NULL").select("trial_id", "sr_period")


def open_holdout(panel: DataFrame, path: str, strategy_id: str, params: dict, source: str, reason: str, now: str, splits: Splits = Splits()) -> DataFrame:
    """The whole panel, after noting the one look at the holdout that a strategy has; a second look raises, as does a panel without a holdout."""
    spark = panel.sparkSession
    looks = load(spark, path, LOOKS)
    if looks.where(F.col("strategy_id") == strategy_id).limit(1).count():
        raise HoldoutViolation(f"{strategy_id} has had its look at the holdout")
    first, last = panel.where(F.col("date") > F.lit(splits.val_end).cast("date")).agg(F.min("date"), F.max("date")).first()
    if first is None:
        raise HoldoutViolation("the panel has no rows after validation")
    row = [(now, strategy_id, json.dumps(params, sort_keys=True), splits.name, source, str(first), str(last), reason)]
    spark.createDataFrame(row, LOOKS).coalesce(1).write.mode("append").csv(path, header=True)
    return panel
