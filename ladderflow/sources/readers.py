"""Sources: landed pages of feeds, CSV and JSON files, snapshots, and adapters to the canonical market.

All readers take explicit schemas, so no pass over the data is spent on inference and unknown keys are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.functions.text import parse_json_array
from ladderflow.operators.arb import top_per_group
from ladderflow.sources import schemas


def json_pages(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Landed JSON, one object a line or one array a file."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str, drop_malformed: bool = True) -> DataFrame:
    """CSV with a header; rows that do not fit the schema are dropped."""
    return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED" if drop_malformed else "PERMISSIVE")


def json_lines(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Learning events of the given kinds."""
    return spark.read.schema(schemas.LEARNING_EVENT).json(path).where(F.col("event_type").isin(*kinds))


#: Partition column of a table that is cut into so many buckets of tokens.
BUCKET = "bucket_of_"


def token_bucket(token: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(n)).cast("int")


def snapshots(spark: SparkSession, path: str, start: str, end: str, token_ids: list[str] | None = None, in_order: bool = True) -> DataFrame:
    """Snapshots between two times (ISO text, compared as text), of some tokens; filters reach the scan.

    Of a table that sinks.append_by_day() wrote, only the folders of the days in between are listed (and those of rows whose day
    is unknown), and only those of the tokens' buckets, if it has any. in_order sorts the result by time, which is a shuffle."""
    table = spark.read.schema(schemas.SNAPSHOT).parquet(path)
    rows = table.where(F.col("timestamp").between(start, end))
    if "date" in table.columns:
        rows = rows.where(F.col("date").isNull() | F.col("date").cast("string").between(start[:10], end[:10]))
    if token_ids:
        rows = rows.where(F.col("token_id").isin(*token_ids))
        for c in table.columns:
            if c.startswith(BUCKET):
                rows = rows.where(F.col(c).isin(*(token_bucket(F.lit(t), int(c[len(BUCKET) :])) for t in token_ids)))
    return rows.orderBy("timestamp") if in_order else rows


def count_snapshots(spark: SparkSession, path: str) -> int:
    """Number of snapshots, from file footers."""
    return spark.read.schema(schemas.SNAPSHOT).parquet(path).count()


def union_first_wins(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Pages of several scans; of rows with one key that of the first scan, page and position stays. The parts carry
    page and pos."""
    rows = parts[0].withColumn("src", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("src", F.lit(i)))
    return top_per_group(rows, key, ["src", "page", "pos"])


def parse_time(*candidates: Column) -> Column:
    """The first candidate that is a time; a blank may stand for T, and Z for +00:00."""
    text = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r"\+00$", "+00:00")
    return F.coalesce(*(F.try_to_timestamp(text(c)) for c in candidates))


def market_tokens(raw: DataFrame) -> DataFrame:
    """Outcomes, prices and token ids of a raw market, zipped; a missing price is 0 and a missing id empty."""
    names, prices, ids = (parse_json_array(F.col(c)) for c in ("outcomes", "outcomePrices", "clobTokenIds"))
    zipped = F.transform(names, lambda n, i: F.struct(n.alias("outcome"), F.coalesce(F.get(prices, i).try_cast("double"), F.lit(0.0)).alias("price"), F.coalesce(F.get(ids, i), F.lit("")).alias("token_id")))
    return raw.withColumn("tokens", zipped)


def adapt_market(raw: DataFrame) -> DataFrame:
    """A raw prediction market as canonical market."""
    m = market_tokens(raw)
    return m.select(
        F.coalesce("condition_id", "conditionId", "id").alias("id"), F.coalesce("question", "title").alias("name"), F.col("category").alias("competition"),
        parse_time(F.col("gameStartTime"), F.col("startDate"), F.col("endDate")).alias("open_date"), F.lit("BINARY").alias("market_type"), F.lit("prediction").alias("exchange"),
        F.transform("tokens", lambda t: F.struct(t["token_id"].alias("selection_id"), t["outcome"].alias("name"), t["price"].alias("price"))).alias("runners"),
    )


def adapt_catalogue(raw: DataFrame) -> DataFrame:
    """An exchange's catalogue row as canonical market; prices come from the ladder."""
    return raw.select(
        F.col("marketId").alias("id"), F.coalesce("event.name", "marketName").alias("name"), F.col("competition.name").alias("competition"), parse_time(F.col("marketStartTime")).alias("open_date"),
        F.coalesce("description.marketType", F.lit("MATCH_ODDS")).alias("market_type"), F.lit("exchange").alias("exchange"),
        F.transform("runners", lambda r: F.struct(r["selectionId"].cast("string").alias("selection_id"), r["runnerName"].alias("name"), F.lit(None).cast("double").alias("price"))).alias("runners"),
    )


def adapt_pair_market(raw: DataFrame) -> DataFrame:
    """Rows (marketHash, teamOneName, teamTwoName, leagueLabel, gameTime, outcomeOneName, outcomeTwoName) as
    canonical market with two made-up runners 1 and 2; of rows with one hash the first stays."""
    time = F.when(F.col("gameTime").rlike(r"^\d+$"), F.timestamp_seconds(F.when(F.col("gameTime").try_cast("double") > 4_102_444_800, F.col("gameTime").try_cast("double") / 1000).otherwise(F.col("gameTime").try_cast("double")))).otherwise(parse_time(F.col("gameTime")))
    runner = lambda n, c: F.struct(F.lit(n).alias("selection_id"), F.col(c).alias("name"), F.lit(None).cast("double").alias("price"))
    return raw.dropDuplicates(["marketHash"]).select(
        F.col("marketHash").alias("id"), F.concat_ws(" vs ", "teamOneName", "teamTwoName").alias("name"), F.col("leagueLabel").alias("competition"), time.alias("open_date"), F.lit("").alias("market_type"),
        F.lit("pairs").alias("exchange"), F.array(runner("1", "outcomeOneName"), runner("2", "outcomeTwoName")).alias("runners"),
    )


def top_of_ladder(raw: DataFrame) -> DataFrame:
    """Per runner best back and lay price and size (0 if none), sizes of the best three, and the stamp set back a
    quarter of an hour for delayed data."""
    r = raw.select("marketId", "isMarketDataDelayed", F.explode("runners").alias("r"))
    first = lambda side, field: F.coalesce(F.get(F.col(f"r.ex.{side}"), F.lit(0))[field], F.lit(0.0))
    three = lambda side: F.coalesce(F.aggregate(F.slice(F.col(f"r.ex.{side}"), 1, 3), F.lit(0.0), lambda s, x: s + x["size"]), F.lit(0.0))
    delay = F.when(F.col("isMarketDataDelayed"), 15).otherwise(0)
    return r.select(
        "marketId", F.col("r.selectionId").alias("selection_id"), first("availableToBack", "price").alias("back"), first("availableToBack", "size").alias("back_size"), first("availableToLay", "price").alias("lay"),
        first("availableToLay", "size").alias("lay_size"), three("availableToBack").alias("back_top3"), three("availableToLay").alias("lay_top3"), delay.alias("delay_minutes"),
    )


def dictionary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON sport -> canonical -> [aliases] as rows (sport, alias, canonical, version): one object a file, or one a line, which
    any number of tasks can read."""
    text = spark.read.text(path, wholetext=not lines)
    parsed = text.select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    a = parsed.select(F.explode("m").alias("sport", "names")).select("sport", F.explode("names").alias("canonical", "aliases"))
    return a.select("sport", "canonical", F.posexplode(F.array_union(F.array("canonical"), "aliases")).alias("version", "alias"))


def prometheus(spark: SparkSession, path: str) -> DataFrame:
    """Metrics text as (name, value); comments and what is no number are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))
    return rows.where("value is not null")


def transfers(raw: DataFrame, wallets: DataFrame, after_block: int) -> DataFrame:
    """Transfers of followed wallets after a block: BUY if the wallet receives, else SELL."""
    new = raw.where(F.col("block") > after_block).withColumn("_to", F.lower("to")).withColumn("_from", F.lower("from"))
    w = wallets.select(F.lower("wallet").alias("wallet")).distinct()
    bought = new.join(w, F.col("_to") == F.col("wallet")).withColumn("side", F.lit("BUY"))
    sold = new.join(w, (F.col("_from") == F.col("wallet")) & ~F.col("_to").eqNullSafe(F.col("wallet"))).withColumn("side", F.lit("SELL"))  # a transfer to oneself is bought, once
    return bought.unionByName(sold).drop("_to", "_from")


def with_props(h2h: DataFrame, props: DataFrame, most: int = 5, sports: tuple[str, ...] = ("basketball_nba", "americanfootball_nfl")) -> DataFrame:
    """Head-to-head events (event_id, sport, pos, ...) of all leagues, and behind them the prop rows of the first
    so many events of the sports that have props. Sent as a limit before the join, so few events are looked up."""
    chosen = h2h.where(F.col("sport").isin(*sports)).orderBy("pos").limit(most).select("event_id")
    return h2h.withColumn("step", F.lit(1)).unionByName(props.join(F.broadcast(chosen), "event_id", "left_semi").withColumn("step", F.lit(2)), allowMissingColumns=True)


def first_known(*sources: tuple[str, Column]) -> Column:
    """Struct of the first source that answers, and its value."""
    return F.coalesce(*(F.when(x.isNotNull(), F.struct(F.lit(name).alias("source"), x.cast("double").alias("value"))) for name, x in sources))


def sparql_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Landed bindings of a query, one a line: label, alt."""
    return json_pages(spark, path, "clubLabel struct<value:string>, altLabel struct<value:string>").select(F.col("clubLabel.value").alias("label"), F.col("altLabel.value").alias("alt"))


def new_aliases(bindings: DataFrame, known: DataFrame) -> DataFrame:
    """Alias, label of bindings (label, alt) whose folded alias is neither empty, nor the label itself, nor known (alias of
    any sport). Of several labels the least stays."""
    key = F.lower(F.trim("alt"))
    rows = bindings.where("label <> '' AND alt <> ''").select(key.alias("alias"), "label").where((F.col("alias") != "") & (F.col("alias") != F.lower(F.trim("label"))))
    return rows.join(known.select("alias"), "alias", "left_anti").groupBy("alias").agg(F.min("label").alias("label"))


def discovery_counters(markets: DataFrame) -> DataFrame:
    """For each page of a scan (page, accepting_orders, closed, tokens array) and for all of them (page null): markets, how many
    accept orders, how many can be traded (and are not closed), and how many of these have two tokens at least."""
    accepting = F.coalesce("accepting_orders", F.lit(False))
    open_ = accepting & ~F.coalesce("closed", F.lit(False))
    return markets.rollup("page").agg(
        F.count("*").alias("markets"), F.count_if(accepting).alias("accepting"), F.count_if(open_).alias("tradeable"), F.count_if(open_ & (F.size(F.coalesce("tokens", F.array())) >= 2)).alias("two_sided"),
    )


def seed_rows(entities: DataFrame, done: DataFrame) -> DataFrame:
    """Alias rows (league, canonical, alias) of the entities (league, name, code) of leagues that are not done."""
    new = entities.join(done.select("league").distinct(), "league", "left_anti")
    return new.select("league", F.col("name").alias("canonical"), F.explode(F.array_distinct(F.array_compact(F.array("name", "code")))).alias("alias"))


def hex_to_decimal(x: Column) -> Column:
    """A hexadecimal id of up to 256 bits in decimal digits; others pass unchanged. Wider than any SQL number, so an
    Arrow-batched function does it."""

    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda v: str(int(v, 16)) if v is not None and v.lower().startswith("0x") else v)

    return F.pandas_udf(run, "string")(x)


def event_markets(spark: SparkSession, path: str) -> DataFrame:
    """Landed events with their groups of markets: (event_id, title, market_id, question, price of the first token), open
    markets only."""
    e = json_pages(spark, path, schemas.RAW_EVENT).select(F.col("id").alias("event_id"), "title", F.explode("markets").alias("m")).where(~F.coalesce("m.closed", F.lit(False)))
    return e.select("event_id", "title", F.col("m.id").alias("market_id"), F.col("m.question").alias("question"), F.get("m.tokens", F.lit(0))["price"].alias("price"))
