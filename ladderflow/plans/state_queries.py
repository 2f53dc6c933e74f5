"""Queries over streams with keyed state, deadlines and committed batches; the SQL is over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators.scratch import own_folder
from ladderflow.plans import book_queries  # noqa: F401  its SQL is used here
from ladderflow.plans.catalog import ORACLE, query
from ladderflow.plans.proxies import TICKS, q, quantise, table
from ladderflow.streaming import machines
from ladderflow.streaming.committed import run_committed
from ladderflow.streaming.ticks import read_ticks

#: Event time that is waited for late rows. SQL needs it for what happens behind the last row of a key.
DELAY_SECONDS = 601


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_ticks(spark, path, spark.read.parquet(path).schema)


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stream_of(spark, sf_dir, "events")
    return raw.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value")


def run(spark: SparkSession, stream: DataFrame, mode: str = "append", **options) -> DataFrame:
    """The committed rows of a stream over all that is there."""
    return run_committed(stream, f"{own_folder(spark)}/committed-{uuid.uuid4().hex}", mode, **options)


def machine(spark: SparkSession, ticks: DataFrame, one: machines.Machine) -> DataFrame:
    out = run(spark, machines.run_machine(ticks, one, delay=f"{DELAY_SECONDS} seconds"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Whether a deadline d of a key is met: by a later row of the key or by the last watermark.
MARK = f"wm AS (SELECT epoch_us(max(ts)) // 1000 - {DELAY_SECONDS * 1000} AS wm FROM tick)"


def _met(d: str, strict: bool = False) -> str:
    return f"((epoch_us({d}) + 999) // 1000 <= (SELECT wm FROM wm) OR EXISTS (SELECT 1 FROM tick z WHERE z.key = x.key AND z.ts {'>' if strict else '>='} {d}))"


def _book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    raw = stream_of(spark, sf_dir, "lineitem").withColumn("size", size)
    seq = F.array(*(F.col(c).cast("double") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "size")))
    kind = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 4 == 0), "snapshot").otherwise("delta")
    return raw.select(F.col("l_partkey").alias("book_id"), seq.alias("seq"), kind.alias("kind"), F.col("l_linestatus").alias("side"), F.col("l_discount").alias("price"), "size")


@query("stream_l2_book", "T03", ORACLE["l2_book_replay"])
def stream_l2_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level updates as a stream; the kept levels give what the replay gives in batch."""
    changes = run(spark, machines.book_stream(_book_rows(spark, sf_dir).withColumn("kind", F.lit("delta")), bid="F"), "update")
    return machines.last_levels(changes)


@query("stream_book_tops", "T03 A08", f"""WITH d AS (SELECT l_partkey AS book_id, l_linestatus AS side, l_discount AS price, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS size, l_linenumber = 1 AND l_orderkey % 4 = 0 AS snap,
 dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END) AS n FROM lineitem),
 s AS (SELECT *, max(CASE WHEN snap THEN n ELSE 0 END) OVER (PARTITION BY book_id) AS cleared FROM d), b AS (SELECT DISTINCT book_id FROM d),
 l AS (SELECT book_id, side, price, arg_max(size, n) AS size FROM s WHERE n >= cleared GROUP BY 1, 2, 3),
 t AS (SELECT book_id, max(price) FILTER (WHERE side = 'F') AS best_bid, sum(0) AS z, min(price) FILTER (WHERE side <> 'F') AS best_ask, count(*) AS levels FROM l WHERE size > 0 GROUP BY 1)
 SELECT book_id, best_bid, coalesce(x.size, 0.0) AS bid_size, best_ask, coalesce(y.size, 0.0) AS ask_size, {q('(best_bid + best_ask) / 2')} AS mid, {q('best_ask - best_bid')} AS spread, coalesce(levels, 0) AS levels
 FROM b LEFT JOIN t USING (book_id) LEFT JOIN l x ON x.book_id = b.book_id AND x.side = 'F' AND x.price = best_bid LEFT JOIN l y ON y.book_id = b.book_id AND y.side <> 'F' AND y.price = best_ask""")
def stream_book_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prices of books that snapshots clear now and then."""
    tops = machines.last_tops(run(spark, machines.book_stream(_book_rows(spark, sf_dir), tops=True, bid="F"), "update"))
    return tops.withColumn("mid", quantise(F.col("mid"))).withColumn("spread", quantise(F.col("spread")))


@query("stream_guardian", "T10 W10", f"""WITH {TICKS}, {MARK}, i AS (SELECT *, value - 50 AS pnl, sum(CASE WHEN value - 50 < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM tick),
 s AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS streak, 1000 + sum(pnl) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS balance FROM i),
 p AS (SELECT *, greatest(1000 - balance, 0) / 1000 AS drawdown FROM s), b AS (SELECT *, CASE WHEN drawdown > 0.1 OR streak >= 3 THEN ts + INTERVAL 1 DAY END AS stop FROM p),
 r AS (SELECT *, max(stop) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS pause_until FROM b),
 x AS (SELECT key, stop, lead(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS next FROM b WHERE stop IS NOT NULL)
 SELECT key, seq, ts, 'trade' AS event, CAST(streak AS BIGINT) AS streak, {q('drawdown')} AS drawdown, pause_until FROM r
 UNION ALL SELECT key, NULL, stop, 'lifted', NULL, NULL, stop FROM x WHERE (next IS NULL OR next >= stop) AND {_met('stop')}""")
def stream_guardian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses of a day after three losers or a tenth of the balance lost; timers lift them."""
    ticks = tick_stream(spark, sf_dir).select("key", "seq", "ts", (F.col("value") - 50).alias("pnl"))
    out = machine(spark, ticks, machines.Guardian(1000.0, 0.1, 3, 1_440))
    return out.select("key", "seq", "ts", "event", "streak", quantise(F.col("drawdown")).alias("drawdown"), F.timestamp_micros("pause_until").cast("timestamp_ntz").alias("pause_until"))


_CHECKED = """o AS (SELECT key, seq, ts, nullif(concat_ws(',', CASE WHEN kind = 'error' THEN 'error_rate' END, CASE WHEN value * 3 >= 250 THEN 'latency' END, CASE WHEN value >= 90 THEN 'volatility' END), '') AS why,
 row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn FROM tick), f AS (SELECT * FROM o WHERE why IS NOT NULL)"""


@query("stream_operational", "T13 T11", f"""WITH RECURSIVE {TICKS}, {MARK}, {_CHECKED}, trip AS (SELECT key, rn, ts, why FROM f WHERE rn = (SELECT min(rn) FROM f g WHERE g.key = f.key)
 UNION ALL SELECT key, rn, ts, why FROM (SELECT f.*, row_number() OVER (PARTITION BY f.key ORDER BY f.rn) AS pick FROM trip JOIN f ON f.key = trip.key AND f.rn > trip.rn AND f.ts > trip.ts + INTERVAL 2 DAY) WHERE pick = 1),
 x AS (SELECT key, ts + INTERVAL 2 DAY AS until FROM trip)
 SELECT o.key, o.seq, o.ts, 'checked' AS event, t.why IS NOT NULL AS tripped, t.why AS reason FROM o LEFT JOIN trip t ON t.key = o.key AND t.rn <= o.rn AND o.ts <= t.ts + INTERVAL 2 DAY
 UNION ALL SELECT key, NULL, until, 'reset', false, NULL FROM x WHERE {_met('until', True)}""")
def stream_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks are sparse, so the cooldown is two days here; the rule is the same."""
    v = F.col("value")
    ticks = tick_stream(spark, sf_dir).select("key", "seq", "ts", v.alias("volatility"), F.lit(45.0).alias("base"), F.when(F.col("kind") == "error", 0.06).otherwise(0.0).alias("error_rate"), (v * 3).alias("latency"))
    return machine(spark, ticks, machines.Operational(2 * 86_400)).select("key", "seq", "ts", "event", "tripped", "reason")


@query("stream_capital", "T06 T22", f"""WITH {TICKS}, {MARK}, d AS (SELECT *, CAST(ts AS DATE) AS day, CASE WHEN seq % 97 = 0 THEN 0.0 ELSE 1000 + value END AS balance FROM tick),
 s AS (SELECT *, first_value(balance) OVER w AS start, count(*) OVER w AS attempts, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER w AS failed FROM d WINDOW w AS (PARTITION BY key, day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT *, CASE WHEN balance < 10 THEN 'balance' WHEN start > 0 AND (start - balance) / start > 0.05 THEN 'drawdown' WHEN attempts >= 3 AND failed / attempts > 0.2 THEN 'errors' END AS why FROM s),
 l AS (SELECT *, first_value(why IGNORE NULLS) OVER (PARTITION BY key, day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS reason FROM r),
 x AS (SELECT key, CAST(day + INTERVAL 1 DAY AS TIMESTAMP) AS ends, max(attempts) AS attempts, arg_max(reason, attempts) AS reason FROM l GROUP BY key, day HAVING count(reason) > 0)
 SELECT key, seq, ts, 'checked' AS event, balance, attempts, reason IS NOT NULL AS broken, reason FROM l
 UNION ALL SELECT key, NULL, ends, 'rollover', NULL, attempts, false, reason FROM x WHERE {_met('ends')}""")
def stream_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker of each key and day; midnight closes it again."""
    raw = F.when(F.col("seq") % 97 == 0, "invalid").otherwise((1000 + F.col("value")).cast("string"))
    ticks = tick_stream(spark, sf_dir).select("key", "seq", "ts", raw.alias("balance"), (F.col("kind") != "error").alias("ok"))
    return machine(spark, ticks, machines.Capital(warmup=3)).select("key", "seq", "ts", "event", "balance", "attempts", "broken", "reason")


@query("stream_cache", "T19 K14", f"""WITH {TICKS}, {MARK}, o AS (SELECT key, seq, ts, kind IN ('purchase', 'signup') AS put, CAST(seq AS VARCHAR) AS data FROM tick),
 l AS (SELECT *, last_value(CASE WHEN put THEN ts END IGNORE NULLS) OVER w AS stamp, last_value(CASE WHEN put THEN data END IGNORE NULLS) OVER w AS held FROM o WINDOW w AS (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 x AS (SELECT key, data, ts + INTERVAL 1 DAY AS ends, lead(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS next FROM o WHERE put)
 SELECT key, seq, ts, CASE WHEN put THEN 'stored' WHEN ts < stamp + INTERVAL 1 DAY THEN 'hit' ELSE 'miss' END AS event, CASE WHEN put THEN data WHEN ts < stamp + INTERVAL 1 DAY THEN held END AS data FROM l
 UNION ALL SELECT key, NULL, ends, 'expired', data FROM x WHERE (next IS NULL OR next >= ends) AND {_met('ends')}""")
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that live for a day: hits, misses and expiries of a sequence of events."""
    op = F.when(F.col("kind").isin("purchase", "signup"), "put").otherwise("get")
    ticks = tick_stream(spark, sf_dir).select("key", "seq", "ts", op.alias("op"), F.col("seq").cast("string").alias("data"), F.lit(None).cast("double").alias("ttl"))
    return machine(spark, ticks, machines.Cache(86_400)).select("key", "seq", "ts", "event", "data")


@query("stream_committed", "K08 T15 T16", f"WITH {TICKS} SELECT seq, key, kind, value FROM tick")
def stream_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch fails behind its write and before its commit, then behind its commit: no row is lost or doubled."""
    left = ["before", "after"]

    def fail(when: str):
        def run_once(_: int) -> None:
            if left and left[0] == when:
                left.pop(0)
                raise RuntimeError(f"broken off {when} the commit")

        return run_once

    rows = tick_stream(spark, sf_dir).select("seq", "key", "kind", "value")
    return run(spark, rows, partition_by=["kind"], attempts=3, first_wait=0.1, before_commit=fail("before"), after_commit=fail("after")).select("seq", "key", "kind", "value")
