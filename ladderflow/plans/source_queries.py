"""Queries over sources, adapters and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators.scratch import own_folder
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import TICKS, q, quantise, table, ticks
from ladderflow.plans.risk_queries import SIGNALS
from ladderflow.sources import readers, schemas, sinks
from ladderflow.streaming import ticks as streaming


@query("adapted_markets", "S01 S15 Y28 Y29 P02", """SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS id, 'Q ' || o_orderpriority AS name, CAST(strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS TIMESTAMP) AS open_date, 2 AS n_runners,
 floor(CAST(o_orderkey % 100 AS DOUBLE) / 100 * 1e6 + 0.5) / 1e6 AS first_price, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 't' || CAST(o_orderkey AS VARCHAR) END AS second_id FROM orders""")
def adapted_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw markets as landed (arrays in strings, alternative keys, times with a blank) to canonical markets."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    raw = table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("c"), text)).alias("condition_id"), F.when(k % 2 == 1, F.concat(F.lit("c"), text)).alias("conditionId"), F.concat(F.lit("Q "), "o_orderpriority").alias("question"),
        F.when(k % 5 == 0, "no date").alias("gameStartTime"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00+00")).alias("startDate"), F.lit('["Yes","No"]').alias("outcomes"),
        F.concat(F.lit('["'), (k % 100 / 100).cast("string"), F.lit('"]')).alias("outcomePrices"), F.when(k % 3 == 0, '["a"]').otherwise(F.concat(F.lit('["a","t'), text, F.lit('"]'))).alias("clobTokenIds"),
    )).alias("json"))
    markets = readers.adapt_market(raw.select(F.from_json("json", schemas.RAW_MARKET).alias("m")).select("m.*"))
    run = lambda i: F.get("runners", F.lit(i))
    return markets.select("id", "name", F.col("open_date").cast("timestamp_ntz").alias("open_date"), F.size("runners").alias("n_runners"), quantise(run(0)["price"]).alias("first_price"), run(1)["selection_id"].alias("second_id"))


@query("adapted_pairs", "S11 S14 Y01", """SELECT 'h' || CAST(p_partkey AS VARCHAR) AS id, p_name || ' vs ' || p_brand AS name, epoch_us(CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2025-01-01' + INTERVAL 1 SECOND * p_partkey ELSE TIMESTAMP '2025-01-01' + INTERVAL 1 SECOND * p_partkey END) AS micros, '1|2' AS runners FROM part""")
def adapted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds in even rows, milliseconds in odd ones; rows that repeat a hash are dropped."""
    k = F.col("p_partkey")
    seconds = 1_735_689_600 + k
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.lit("h"), k.cast("string")).alias("marketHash"), F.col("p_name").alias("teamOneName"), F.col("p_brand").alias("teamTwoName"), F.col("p_type").alias("leagueLabel"),
        F.when(k % 2 == 0, seconds).otherwise(seconds * 1000).cast("string").alias("gameTime"), F.col("p_name").alias("outcomeOneName"), F.col("p_brand").alias("outcomeTwoName"),
    )
    rows = readers.adapt_pair_market(raw.union(raw))
    return rows.select("id", "name", F.unix_micros("open_date").alias("micros"), F.array_join(F.transform("runners", lambda r: r["selection_id"]), "|").alias("runners"))


@query("ladder_tops", "S06 S07 S09", """WITH r AS (SELECT l_orderkey, l_extendedprice AS price, l_quantity AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem)
 SELECT l_orderkey AS market, max(price) FILTER (WHERE rn = 1) AS back, max(size) FILTER (WHERE rn = 1) AS back_size, 0.0 AS lay, sum(size) FILTER (WHERE rn <= 3) AS back_top3, CASE WHEN l_orderkey % 2 = 0 THEN 15 ELSE 0 END AS delay_minutes FROM r GROUP BY 1""")
def ladder_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"))), asc=False).alias("ladder"))
    none = F.array().cast("array<struct<price:double,size:double>>")
    runner = F.struct(F.lit(1).cast("bigint").alias("selectionId"), F.lit(None).cast("double").alias("lastPriceTraded"), F.struct(F.col("ladder").alias("availableToBack"), none.alias("availableToLay")).alias("ex"))
    raw = line.select(F.col("l_orderkey").cast("string").alias("marketId"), (F.col("l_orderkey") % 2 == 0).alias("isMarketDataDelayed"), F.array(runner).alias("runners"))
    return readers.top_of_ladder(raw).select(F.col("marketId").cast("long").alias("market"), "back", "back_size", "lay", "back_top3", "delay_minutes")


@query("upserted_rows", "K03 K06 K12", """WITH o AS (SELECT o_custkey AS key, o_orderkey AS version, o_totalprice AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM o) SELECT key, version, v FROM r WHERE rn = 1""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("v"))
    return sinks.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), "key", "version")


@query("queue_append", "K07", """SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linestatus = 'O' AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_linestatus <> 'O')""")
def queue_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_linestatus")
    return sinks.queue_append(rows.where("l_linestatus <> 'O'"), rows.where("l_linestatus = 'O'"), ["a", "b"]).select("a", "b")


@query("filtered_titles", "S25 S28", """SELECT p_partkey FROM part WHERE NOT contains(p_name, 'blue')""")
def filtered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(~F.col("p_name").contains("blue")).select("p_partkey")


@query("hex_ids", "Y32", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'plain' || CAST(o_orderkey AS VARCHAR) END AS id FROM orders""")
def hex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", readers.hex_to_decimal(F.when(k % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).otherwise(F.concat(F.lit("plain"), k.cast("string")))).alias("id"))


@query("theta_vectors", "Y33", f"""SELECT l_orderkey AS market, {q('min((l_discount + l_tax) / 2)')} AS least_mid, count(*) AS n FROM lineitem GROUP BY 1""")
def theta_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = (F.col("l_discount") + F.col("l_tax")) / 2
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("market")).agg(F.collect_list(mid).alias("theta"))
    return rows.select("market", quantise(F.array_min("theta")).alias("least_mid"), F.size("theta").cast("long").alias("n"))


@query("tick_fees", "T01 T24", f"""WITH {TICKS} SELECT seq, {q('value * (1 - 0.065)')} AS best_bid, {q('(value + 1) * (1 + 0.065)')} AS best_ask FROM tick WHERE key IN (SELECT key FROM tick WHERE kind = 'purchase')""")
def tick_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets are followed from a first purchase on."""
    t = ticks(spark, sf_dir).select("seq", "kind", F.col("key").cast("string").alias("market_id"), F.col("value").alias("best_bid"), (F.col("value") + 1).alias("best_ask"))
    wanted = t.where("kind = 'purchase'").select("market_id").distinct()
    rows = streaming.with_fee(streaming.subscribed(t, wanted), 6.5)
    return rows.select("seq", quantise(F.col("best_bid")).alias("best_bid"), quantise(F.col("best_ask")).alias("best_ask"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = streaming.read_ticks(spark, path, schema)
    return raw.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value")


@query("tick_window_counts", "T02 T14 T21", f"""WITH {TICKS} SELECT time_bucket(INTERVAL '6 hours', ts) AS start, kind, count(*) AS n, max(ts) AS last FROM tick GROUP BY 1, 2""")
def tick_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the event files, run to its end; equals the batch."""
    path = streaming.run_available(streaming.window_counts(_stream(spark, sf_dir)), own_folder(spark), "complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.parquet(path).select(ntz("start"), "kind", "n", ntz("last"))


@query("stream_latest_prices", "T04 J18 T22", f"""WITH {TICKS}, s AS (SELECT seq, ts, seq % 40 AS mapping, CASE WHEN kind IN ('view', 'click') THEN 'A' ELSE 'B' END AS side, value FROM tick),
 l AS (SELECT seq, mapping, last_value(CASE WHEN side = 'A' THEN value END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN side = 'B' THEN value END IGNORE NULLS) OVER w AS b FROM s
 WINDOW w AS (PARTITION BY mapping ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) SELECT seq, mapping, a, b FROM l WHERE a IS NOT NULL AND b IS NOT NULL""")
def stream_latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state of a stream gives what the window gives in batch."""
    t = _stream(spark, sf_dir).select("seq", "ts", (F.col("seq") % 40).alias("mapping"), F.when(F.col("kind").isin("view", "click"), "A").otherwise("B").alias("side"), "value")
    return spark.read.parquet(streaming.run_available(streaming.latest_prices(t), own_folder(spark)))


@query("stream_signals", "T07 T08 T20 F09", SIGNALS)
def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful dedup of a stream; a test holds it against the batch twin."""
    t = _stream(spark, sf_dir).select("seq", "ts", F.concat_ws("-", F.col("key").cast("string"), "kind").alias("key"), F.col("value").alias("profit"))
    return spark.read.parquet(streaming.run_available(streaming.refiring_signals(t, 10 * 86_400.0), own_folder(spark)))


@query("catalogue_flatten", "S08 S03", """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'E' || CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'MATCH_ODDS' ELSE o_orderpriority END AS market_type, n AS selection_id, 'R' || n AS runner
 FROM orders, (VALUES ('1'), ('2')) v(n) WHERE o_orderstatus = 'O'""")
def catalogue_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested catalogue rows as landed JSON, one row for each runner."""
    k = F.col("o_orderkey")
    runner = lambda n: F.struct(F.lit(n).cast("bigint").alias("selectionId"), F.lit(f"R{n}").alias("runnerName"))
    raw = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O").select(F.to_json(F.struct(
        k.cast("string").alias("marketId"), F.struct(F.lit("e").alias("id"), F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("name")).alias("event"),
        F.when(k % 4 != 0, F.struct(F.col("o_orderpriority").alias("marketType"))).alias("description"), F.array(runner(1), runner(2)).alias("runners"),
    )).alias("json"))
    rows = readers.adapt_catalogue(raw.select(F.from_json("json", schemas.RAW_CATALOGUE).alias("m")).select("m.*"))
    return rows.select("id", "name", "market_type", F.explode("runners").alias("r")).select("id", "name", "market_type", F.col("r.selection_id").alias("selection_id"), F.col("r.name").alias("runner"))


@query("csv_history", "S19 S20 K04 K08", """SELECT CAST(o_orderkey AS VARCHAR) AS "Date", o_orderpriority AS "HomeTeam", CASE WHEN o_orderstatus = 'F' THEN 'H' ELSE 'A' END AS "FTR", CAST(o_custkey % 90 AS DOUBLE) / 10 + 1 AS "B365H" FROM orders WHERE o_orderkey % 5 <> 0""")
def csv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds history written as CSV with some broken rows, and read again without them."""
    import uuid

    k = F.col("o_orderkey")
    price = F.when(k % 5 == 0, "broken").otherwise((F.col("o_custkey") % 90 / 10 + 1).cast("string"))
    rows = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("Date"), F.col("o_orderpriority").alias("HomeTeam"), F.lit("x").alias("AwayTeam"), F.when(F.col("o_orderstatus") == "F", "H").otherwise("A").alias("FTR"), price.alias("B365H"), F.lit("2.0").alias("B365D"), F.lit("3.0").alias("B365A")
    )
    path = f"{own_folder(spark)}/csv-{uuid.uuid4().hex}"
    sinks.to_csv(rows, path)
    return readers.csv_rows(spark, path, schemas.ODDS_HISTORY).select("Date", "HomeTeam", "FTR", "B365H")


@query("enriched_aliases", "U07 S34", """WITH f AS (SELECT p_partkey, lower(p_name) AS entity, [upper(p_name), p_brand] AS aliases FROM part), k AS (SELECT DISTINCT lower(p_name) AS entity FROM part WHERE p_name LIKE '%bolt%') SELECT p_partkey, entity, aliases[1] AS canonical FROM f WHERE entity NOT IN (SELECT entity FROM k)""")
def enriched_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found entities that are not known yet; the first alias is the canonical name."""
    part = table(spark, sf_dir, "part")
    found = part.select("p_partkey", F.lower("p_name").alias("entity"), F.array(F.upper("p_name"), F.col("p_brand")).alias("aliases"))
    known = part.where("p_name LIKE '%bolt%'").select(F.lower("p_name").alias("entity")).distinct()
    return found.join(known, "entity", "left_anti").select("p_partkey", "entity", F.get("aliases", F.lit(0)).alias("canonical"))


@query("stream_verified", "T05", f"""WITH {TICKS} SELECT o.key AS key, o.ts AS ts, o.value AS initial, p.value AS now, p.ts AS seen FROM tick o JOIN tick p ON o.key = p.key AND o.kind = 'purchase' AND p.ts >= o.ts + INTERVAL 15 MINUTE AND p.ts <= o.ts + INTERVAL 1 HOUR""")
def stream_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from a quarter of an hour to an hour after an opportunity, by a stream-stream join."""
    rows = lambda: _stream(spark, sf_dir).select("key", F.col("ts").cast("timestamp").alias("ts"), "kind", "value")
    path = streaming.run_available(streaming.verified(rows().where("kind = 'purchase'").drop("kind"), rows().drop("kind")), own_folder(spark))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.parquet(path).select("key", ntz("ts"), "initial", "now", ntz("seen"))


@query("stream_restarted", "T16 T17 F03", f"WITH {TICKS} SELECT seq, key, kind, value FROM tick")
def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscriber fails on its first batch; the stream goes on from its checkpoint, and no row is lost or doubled."""
    failed: list[int] = []

    def subscriber(batch: DataFrame, number: int) -> None:
        if not failed:
            failed.append(number)
            raise RuntimeError("the first batch fails")

    path = streaming.run_restarting(_stream(spark, sf_dir).select("seq", "key", "kind", "value"), own_folder(spark), [subscriber], first_wait=0.1)
    return spark.read.parquet(path).select("seq", "key", "kind", "value")
