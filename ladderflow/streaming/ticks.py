"""Streams of ticks: the same operators as in batch, with state kept by key and late data bounded by a watermark.

Time is event time throughout (the original uses the clock of the process). A tick that is older than what a key has
already seen does not change its state.
"""

from __future__ import annotations

import random
import time
import uuid

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_ticks(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; the source's rate limit bounds what waits in memory."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


def with_fee(ticks: DataFrame, fee_pct: float) -> DataFrame:
    """Bid and ask after fees; a fee of 0 leaves them as they are."""
    return ticks.withColumn("best_bid", F.col("best_bid") * (1 - fee_pct / 100)).withColumn("best_ask", F.col("best_ask") * (1 + fee_pct / 100))


def subscribed(ticks: DataFrame, market_ids: DataFrame) -> DataFrame:
    """Ticks of subscribed markets."""
    return ticks.join(market_ids.select("market_id").distinct(), "market_id", "left_semi")


def window_counts(ticks: DataFrame, width: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Count, sum and last time of each kind in tumbling windows; later data than the delay is dropped."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", width)
    return timed.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select(F.col("w.start").alias("start"), "kind", "n", "last")


def first_signals(ticks: DataFrame, ttl: str) -> DataFrame:
    """T07 without the re-fire rule: one signal of a key within the lifetime."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


LATEST = "seq long, mapping long, a double, b double"


def latest_prices(ticks: DataFrame) -> DataFrame:
    """Ticks (seq, ts, mapping, side A or B, value) meet the last price of the other side; no row until both
    sides are known. Ties in time go by seq."""

    def run(key, batches, state):
        a_at, a, b_at, b = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            stamp = r.ts.value
            if r.side == "A" and (a_at is None or stamp >= a_at):
                a_at, a = stamp, r.value
            elif r.side == "B" and (b_at is None or stamp >= b_at):
                b_at, b = stamp, r.value
            if a is not None and b is not None:
                out.append((r.seq, key[0], a, b))
        state.update((a_at, a, b_at, b))
        yield pd.DataFrame(out, columns=["seq", "mapping", "a", "b"])

    return ticks.groupBy("mapping").applyInPandasWithState(run, LATEST, "a_at long, a double, b_at long, b double", "append", GroupStateTimeout.NoTimeout)


SENT = "seq long, key string, profit double"


#: Keys are dealt to so many groups by their hash. Each group is one call of Python and one state in a batch.
SIGNAL_GROUPS = 8_192


def refiring_signals(ticks: DataFrame, ttl_seconds: float, points: float = 5.0, groups: int = SIGNAL_GROUPS) -> DataFrame:
    """Signals (seq, ts, key, profit) that are new, past the lifetime of the last sent one, or better by the points. The state
    of a group of keys holds the last sending of each of its keys: most keys have a row or two, and a call for each costs
    more than its rows."""

    def run(group, batches, state):
        kept = {k: (at, sent) for k, at, sent in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
        out = []
        for seq, us, key, profit in zip(*(rows[c].tolist() for c in ("seq", "us", "key", "profit")), strict=True):
            if key not in kept or us - kept[key][0] > ttl_seconds * 1e6 or profit >= kept[key][1] + points:
                kept[key] = (float(us), profit)  # microseconds, exact as a double; NaN if there is no time
                out.append((seq, key, profit))
        state.update((list(kept), [at for at, _ in kept.values()], [sent for _, sent in kept.values()]))
        yield pd.DataFrame(out, columns=["seq", "key", "profit"])

    rows = ticks.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"), "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "key", "profit")
    return rows.groupBy("group").applyInPandasWithState(run, SENT, "keys array<string>, at array<double>, sent array<double>", "append", GroupStateTimeout.NoTimeout)


def verified(opportunities: DataFrame, prices: DataFrame, delay_minutes: int = 15, within: str = "1 hour") -> DataFrame:
    """Stream-stream join of opportunities with the prices of their market from the delay on, within a span; both
    sides are bounded by watermarks, so state is dropped as time goes on."""
    o = opportunities.withWatermark("ts", within).alias("o")
    p = prices.withWatermark("ts", within).alias("p")
    on = F.expr(f"o.key = p.key AND p.ts >= o.ts + INTERVAL {delay_minutes} MINUTES AND p.ts <= o.ts + INTERVAL {within}")
    return o.join(p, on).select(F.col("o.key").alias("key"), F.col("o.ts").alias("ts"), F.col("o.value").alias("initial"), F.col("p.value").alias("now"), F.col("p.ts").alias("seen"))


def run_available(stream: DataFrame, base: str, mode: str = "append") -> str:
    """Runs a stream over all that is there and returns the folder that holds its result; checkpoint and result stand
    below base, a shared folder. Stateful queries in complete mode overwrite the result with each batch. In append mode a
    batch's files carry its number, and a batch that is given again replaces them; readers that must not see a batch while
    its files are moved follow manifests instead (committed.run_committed)."""
    root = f"{base}/stream-{uuid.uuid4().hex}"
    context = stream.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(context._jsc.hadoopConfiguration())

    def write(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{root}/result")
            return
        batch.write.mode("overwrite").parquet(f"{root}/staging/{number}")
        fs.mkdirs(path(f"{root}/result"))
        for old in fs.globStatus(path(f"{root}/result/batch-{number}-*")):
            fs.delete(old.getPath(), False)
        for i, part in enumerate(fs.globStatus(path(f"{root}/staging/{number}/*.parquet"))):
            if not fs.rename(part.getPath(), path(f"{root}/result/batch-{number}-{i}.parquet")):
                raise OSError(f"a file of batch {number} could not be moved")

    done = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    done.awaitTermination()
    return f"{root}/result"


def run_restarting(stream: DataFrame, base: str, subscribers: list, attempts: int = 5, first_wait: float = 1.0, longest_wait: float = 60.0) -> str:
    """Runs a stream over all that is there, micro-batch by micro-batch; each batch is written and given to the
    subscribers (functions of a batch and its number). A run that fails is started again from its checkpoint, after a random
    wait that doubles up to the longest; batches are written under their number, so a repeated one replaces itself."""
    root = f"{base}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result/batch={number}")
        for subscriber in subscribers:
            subscriber(batch, number)

    for n in range(attempts):
        try:
            stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
            return f"{root}/result"
        except StreamingQueryException:
            if n == attempts - 1:
                raise
            time.sleep(random.random() * min(longest_wait, first_wait * 2**n))
    return f"{root}/result"
