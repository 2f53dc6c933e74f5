"""Statistics of runs, services and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backtest_metrics(trades: DataFrame, initial: float, run: str = "run_id") -> DataFrame:
    """A10: total, return %, number, win rate, average, Sharpe (0 for one trade or no deviation), final capital."""
    sd = F.stddev_samp("pnl")
    return trades.groupBy(run).agg(
        F.sum("pnl").alias("total"), (F.sum("pnl") / initial * 100).alias("return_pct"), F.count("*").alias("trades"), (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
        F.avg("pnl").alias("avg_pnl"), F.when((F.count("*") <= 1) | (sd == 0), 0.0).otherwise(F.avg("pnl") / sd).alias("sharpe"), (initial + F.sum("pnl")).alias("final"),
    )


def tear_sheet(equity: DataFrame, run: str = "key", per_year: int = 252 * 24 * 60) -> DataFrame:
    """Sharpe of the relative changes and the deepest drawdown of equity rows (run, ts, seq, equity)."""
    w = Window.partitionBy(run).orderBy("ts", "seq")
    before = F.lag("equity").over(w)
    rows = equity.withColumn("r", (F.col("equity") - before) / before).withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sd = F.stddev_samp("r")
    return rows.groupBy(run).agg(
        F.when(sd > 0, F.avg("r") / sd * per_year**0.5).otherwise(0.0).alias("sharpe"), F.min((F.col("equity") - F.col("peak")) / F.col("peak")).alias("max_drawdown"),
    )


def nearest_rank(values: Column, p: float) -> Column:
    """Element int(n p) of the sorted values, the last at most."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.floor(F.size(s) * p).cast("int"), F.size(s) - 1))


def latency(df: DataFrame, key: str = "key", last: int = 200) -> DataFrame:
    """Mean, p95 and p99 by nearest rank of each service's last values."""
    recent = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    kept = df.withColumn("_rn", F.row_number().over(recent)).where(F.col("_rn") <= last)
    rows = kept.groupBy(key).agg(F.avg("value").alias("avg"), F.collect_list("value").alias("vs"))
    return rows.select(key, "avg", nearest_rank(F.col("vs"), 0.95).alias("p95"), nearest_rank(F.col("vs"), 0.99).alias("p99"))


def node_ranking(df: DataFrame, key: str = "key", last: int = 10) -> DataFrame:
    """Mean and deviation of a node's last latencies, success rate, score = mean (2 - rate) + 2 deviations, rank."""
    recent = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    kept = df.withColumn("_rn", F.row_number().over(recent))
    rows = kept.groupBy(key).agg(
        F.avg(F.when(F.col("_rn") <= last, F.col("value"))).alias("avg"), F.stddev_pop(F.when(F.col("_rn") <= last, F.col("value"))).alias("jitter"), F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("rate"),
    )
    return rows.withColumn("score", F.col("avg") * (2 - F.col("rate")) + 2 * F.col("jitter"))


def final_status(steps: DataFrame) -> DataFrame:
    """A trace is rejected by its last failed step (trace_id, step_no, status, reason), else passed."""
    failed = F.col("status") == "FAIL"
    return steps.groupBy("trace_id").agg(F.when(F.count_if(failed) > 0, "REJECTED").otherwise("PASSED").alias("final"), F.max_by(F.when(failed, F.col("reason")), F.when(failed, F.col("step_no"))).alias("reason"), F.count("*").alias("steps"))


def ratio(part: Column, whole: Column) -> Column:
    """Part / whole, 0 without a whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def evaluate_grid(grid: DataFrame, evaluator, schema: str) -> DataFrame:
    """a user's evaluator (a function of one setting, a dict, to a dict of metrics) over all settings of a grid; settings
    run on the executors, and each gives one row of the setting and its metrics."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame([{**r, **evaluator(r)} for r in b.to_dict("records")], columns=[f.split()[0] for f in schema.split(", ")])

    return grid.mapInPandas(run, schema)
