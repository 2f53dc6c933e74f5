"""Queries that land tables as the feeds' files, read them back through the readers, and go on from there; caches; matching
of names. Files are written to the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.functions import predicates
from ladderflow.operators import aggregators, answers, link, risk, stats
from ladderflow.operators.scratch import own_folder
from ladderflow.plans.catalog import query
from ladderflow.plans.fuzzy_sql import scored_pairs
from ladderflow.plans.proxies import OUTCOMES, outcomes, q, quantise, table
from ladderflow.plans.text_queries import titles
from ladderflow.sources import readers, seeding, sinks


def landed(spark: SparkSession, name: str) -> str:
    """A new place for a feed's files."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_union_first_wins", "S01 S02 S03", """WITH u AS (SELECT 0 AS src, p_partkey, 'a ' || p_name AS title FROM part WHERE p_size <= 25 UNION ALL SELECT 1, p_partkey, 'b ' || p_name FROM part)
 SELECT CAST(p_partkey AS VARCHAR) AS id, arg_min(title, src) AS title, min(src) AS src FROM u GROUP BY p_partkey""")
def scan_union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans that land as JSON pages: one of a tag, one of everything."""
    part = table(spark, sf_dir, "part")
    pages = []
    for name, rows in (("a", part.where("p_size <= 25")), ("b", part)):
        path = landed(spark, f"pages-{name}")
        rows.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit(f"{name} "), "p_name").alias("title"), F.floor(F.col("p_partkey") / 100).alias("page"), (F.col("p_partkey") % 100).alias("pos")).write.json(path)
        pages.append(readers.json_pages(spark, path, "id string, title string, page long, pos long"))
    return readers.union_first_wins(pages).select("id", "title", "src")


_SNAPSHOT = """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", CAST(user_id AS VARCHAR) AS token_id, value AS mid_price FROM events"""


def _snapshots(spark: SparkSession, sf_dir: str, buckets: int = 0) -> str:
    """The recorder's snapshots, appended by day."""
    path = landed(spark, "snapshots")
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("").alias("condition_id"), F.col("user_id").cast("string").alias("token_id"), F.col("event_type").alias("outcome"), F.col("value").alias("mid_price"),
        *(F.lit(0.0).alias(c) for c in ("best_bid", "best_ask", "bid_depth", "ask_depth", "spread")),
    )
    sinks.append_by_day(rows, path, buckets=buckets)
    return path


@query("snapshot_scan", "S17 K01 K08", f"""WITH s AS ({_SNAPSHOT}) SELECT * FROM s WHERE "timestamp" BETWEEN '2024-01-10 00:00:00' AND '2024-02-10 12:00:00'""")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.snapshots(spark, _snapshots(spark, sf_dir), "2024-01-10 00:00:00", "2024-02-10 12:00:00", in_order=False).select("timestamp", "token_id", "mid_price")


@query("snapshot_tokens", "S17 K01", f"""WITH s AS ({_SNAPSHOT}) SELECT * FROM s WHERE "timestamp" BETWEEN '2024-01-05 06:00:00' AND '2024-01-20 18:00:00' AND token_id IN ('7', '16', '46', '143')""")
def snapshot_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some tokens of some days: the scan lists the folders of those days and of the tokens' buckets alone."""
    path = _snapshots(spark, sf_dir, buckets=4)
    return readers.snapshots(spark, path, "2024-01-05 06:00:00", "2024-01-20 18:00:00", ["7", "16", "46", "143"], in_order=False).select("timestamp", "token_id", "mid_price")


@query("snapshot_count", "S18 K01", "SELECT count(*) AS n FROM events")
def snapshot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(readers.count_snapshots(spark, _snapshots(spark, sf_dir)),)], "n long")


_NATIONS = """SELECT r_name AS sport, n_name AS canonical, alias, version FROM nation JOIN region ON n_regionkey = r_regionkey, LATERAL (VALUES (n_name, 0), (lower(n_name), 1), (substr(n_name, 1, 3), 2)) v(alias, version)"""


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary files: region -> nation -> aliases, one nation a line."""
    path = landed(spark, "dictionary")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = F.create_map("n_name", F.array(F.lower("n_name"), F.substring("n_name", 1, 3)))
    nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.to_json(F.create_map("r_name", names)).alias("value")).write.text(path)
    return readers.dictionary(spark, path, lines=True)


@query("dictionary_scan", "S21", _NATIONS)
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)


@query("dictionary_compact", "K12 K13", f"""WITH a AS ({_NATIONS}), k AS (SELECT *, row_number() OVER (PARTITION BY sport, canonical, lower(alias) ORDER BY version) AS rn FROM a WHERE length(alias) > 3)
 SELECT sport, canonical, alias FROM k WHERE rn = 1""")
def dictionary_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dictionary(spark, sf_dir).withColumnRenamed("version", "pos")
    return sinks.compact_dictionary(rows, F.length("alias") <= 3).select("sport", "canonical", "alias")


@query("learning_events", "S22 K05", """SELECT CASE p_partkey % 3 WHEN 0 THEN 'match' ELSE 'near_miss' END AS event_type, p_name AS "left", p_brand AS "right", CAST(p_size AS DOUBLE) AS score FROM part WHERE p_partkey % 3 < 2""")
def learning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of three types, of which learning reads two."""
    path = landed(spark, "events")
    part = table(spark, sf_dir, "part")
    for n, kind in enumerate(("match", "near_miss", "other")):
        rows = part.where(F.col("p_partkey") % 3 == n).select(F.lit("2024-01-01").alias("ts"), F.col("p_name").alias("left"), F.col("p_brand").alias("right"), F.col("p_size").cast("double").alias("score"))
        sinks.to_json_lines(rows, path, kind)
    return readers.json_lines(spark, path, ["match", "near_miss"]).select("event_type", "data.*")


@query("prometheus_metrics", "S29", "SELECT 'acct_' || CAST(c_custkey AS VARCHAR) AS name, c_acctbal AS value FROM customer")
def prometheus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landed(spark, "metrics")
    c = table(spark, sf_dir, "customer")
    lines = F.explode(F.array(F.lit("# HELP acct balance"), F.concat(F.lit("acct_"), F.col("c_custkey").cast("string"), F.lit("  "), F.col("c_acctbal").cast("string")), F.lit("acct_bad n/a")))
    c.select(lines.alias("value")).write.text(path)
    return readers.prometheus(spark, path)


@query("wallet_transfers", "S27", """WITH t AS (SELECT l_orderkey AS block, 'S' || CAST(l_suppkey AS VARCHAR) AS "to", 's' || CAST(l_partkey AS VARCHAR) AS "from", l_quantity AS amount FROM lineitem), w AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS wallet FROM supplier)
 SELECT block, wallet, amount, CASE WHEN lower("to") = wallet THEN 'BUY' ELSE 'SELL' END AS side FROM t JOIN w ON lower("to") = wallet OR lower("from") = wallet WHERE block > 100""")
def wallet_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), tag("S", "l_suppkey").alias("to"), tag("s", "l_partkey").alias("from"), F.col("l_quantity").alias("amount"))
    wallets = table(spark, sf_dir, "supplier").select(tag("S", "s_suppkey").alias("wallet"))
    return readers.transfers(raw, wallets, 100).select("block", "wallet", "amount", "side")


@query("odds_two_steps", "S24 S33", """WITH h AS (SELECT o_orderkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 'basketball_nba' ELSE 'soccer_epl' END AS sport FROM orders),
 c AS (SELECT event_id FROM h WHERE sport = 'basketball_nba' ORDER BY event_id LIMIT 5)
 SELECT event_id, sport, CAST(NULL AS BIGINT) AS prop, 1 AS step FROM h UNION ALL SELECT l_orderkey, NULL, CAST(l_linenumber AS BIGINT), 2 FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM c)""")
def odds_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    h2h = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "basketball_nba").otherwise("soccer_epl").alias("sport"), F.col("o_orderkey").alias("pos"))
    props = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("long").alias("prop"))
    return readers.with_props(h2h, props).select("event_id", "sport", "prop", "step")


@query("gas_fallback", "S36", f"""SELECT event_id, CASE WHEN value > 60 THEN 'rpc' WHEN user_id % 2 = 0 THEN 'station' ELSE 'constant' END AS source, {q('CASE WHEN value > 60 THEN value * 1.1 WHEN user_id % 2 = 0 THEN value + 30 ELSE 50 END')} AS fee FROM events""")
def gas_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node's fee, else that of the station, else a constant."""
    v = F.col("value")
    first = readers.first_known(("rpc", F.when(v > 60, v * 1.1)), ("station", F.when(F.col("user_id") % 2 == 0, v + 30)), ("constant", F.lit(50.0)))
    return table(spark, sf_dir, "events").select("event_id", first.alias("x")).select("event_id", "x.source", quantise(F.col("x.value")).alias("fee"))


@query("seeded_aliases", "S31 S32", """WITH e AS (SELECT CAST(n_regionkey AS VARCHAR) AS league, n_name AS name, substr(n_name, 1, 4) AS code FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))
 SELECT league, name AS canonical, name AS alias FROM e UNION SELECT league, name, code FROM e""")
def seeded_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leagues in chunks; the run breaks off behind the first one and is started again, and each alias comes once."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_name NOT LIKE 'A%'")
    entities = nation.select(F.col("n_regionkey").cast("string").alias("league"), F.col("n_name").alias("name"), F.substring("n_name", 1, 4).alias("code"))
    root, calls = landed(spark, "seeds"), []

    def fetch(some: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise OSError("the source does not answer")
        return entities.join(some, "league", "left_semi")

    leagues = region.select(F.col("r_regionkey").alias("league"))
    try:
        return seeding.seed(spark, leagues, fetch, root, chunk=1)
    except OSError:
        return seeding.seed(spark, leagues, fetch, root, chunk=1)


@query("discovery_counters", "S28", """WITH m AS (SELECT o_orderkey // 1000 AS page, o_orderstatus <> 'F' AS accepting, o_orderpriority LIKE '1%' AS closed, o_custkey % 3 AS tokens FROM orders)
 SELECT page, count(*) AS markets, count(*) FILTER (WHERE accepting) AS accepting, count(*) FILTER (WHERE accepting AND NOT closed) AS tradeable, count(*) FILTER (WHERE accepting AND NOT closed AND tokens = 2) AS two_sided FROM m GROUP BY ROLLUP (page)""")
def discovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.transform(F.sequence(F.lit(0), F.col("o_custkey") % 3), lambda i: i)
    markets = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 1000).alias("page"), (F.col("o_orderstatus") != "F").alias("accepting_orders"), F.col("o_orderpriority").startswith("1").alias("closed"), F.slice(tokens, 2, 3).alias("tokens")
    )
    return readers.discovery_counters(markets)


@query("sparql_aliases", "S23 U07", """WITH b AS (SELECT p_name AS label, CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(p_name) WHEN 1 THEN '' WHEN 2 THEN p_brand || ' ' || p_name ELSE p_type || ' ' || p_brand END AS alt FROM part),
 k AS (SELECT lower(p_brand || ' ' || p_name) AS alias FROM part WHERE p_size > 40), f AS (SELECT lower(trim(alt)) AS alias, label FROM b WHERE alt <> '')
 SELECT alias, min(label) AS label FROM f WHERE alias <> '' AND alias <> lower(trim(label)) AND alias NOT IN (SELECT alias FROM k) GROUP BY 1""")
def sparql_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed bindings of labels and their aliases, of which the new ones count."""
    path, part, k = landed(spark, "bindings"), table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    both = F.concat_ws(" ", "p_brand", "p_name")
    alt = F.when(k == 0, F.concat(F.lit(" "), F.upper("p_name"))).when(k == 1, "").when(k == 2, both).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    part.select(F.struct(F.col("p_name").alias("value")).alias("clubLabel"), F.struct(alt.alias("value")).alias("altLabel")).write.json(path)
    return readers.new_aliases(readers.sparql_bindings(spark, path), part.where("p_size > 40").select(F.lower(both).alias("alias")).distinct())


@query("answer_cascade", "F05", """WITH r AS (SELECT o_orderkey, CAST(o_custkey % 12 AS DOUBLE) / 4 AS ev, o_orderkey % 4 = 0 AS hit, o_orderkey % 5 AS a, o_custkey % 2 = 0 AS arb FROM orders)
 SELECT o_orderkey, CASE WHEN ev < 0.5 THEN false WHEN hit THEN true ELSE a < 3 AND arb END AS is_opportunity, CASE WHEN ev < 0.5 THEN 0.0 WHEN hit THEN 0.9 WHEN a < 3 THEN 0.8 ELSE 0.3 END AS confidence,
 CASE WHEN ev < 0.5 THEN 'math_filter' WHEN hit THEN 'cache' ELSE 'primary' END AS source FROM r""")
def answer_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected value, cached answers, the cheap model's and the primary model's, as given in columns."""
    body = F.concat(F.lit('{"is_arb": '), F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("false"), F.lit(', "confidence": 0.8, "reason": "r"}'))
    a = F.col("o_orderkey") % 5
    deep = F.when(a == 0, body).when(a == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(a == 2, F.concat(F.lit("So: "), body, F.lit(" it is"))).when(a == 3, "no idea").otherwise("")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 12 / 4).alias("ev_net"), F.when(F.col("o_orderkey") % 4 == 0, '{"is_arb": true, "confidence": 0.9, "reason": "Cached result"}').alias("cached"), F.when(F.col("o_orderkey") % 3 == 0, "y").otherwise("N").alias("quick"), deep.alias("deep")
    )
    return answers.cascade(rows).select("o_orderkey", "is_opportunity", "confidence", "source")


@query("market_aggregator", "F09 A02", f"""WITH {OUTCOMES} SELECT event_id, count(*) AS outcomes, {q('sum(price)', 4)} AS total, arg_min(token_id, {{'p': price, 't': token_id}}) AS cheapest, {q('1 - sum(price)', 4)} AS gain FROM outcome GROUP BY 1""")
def market_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate over the outcomes of each supplier: partial states in each task, merged behind the shuffle."""
    found = aggregators.aggregate(outcomes(spark, sf_dir), ["event_id"], aggregators.MarketPrices())
    return found.withColumn("total", quantise(F.col("total"), 4)).withColumn("gain", quantise(F.col("gain"), 4))


@query("mapping_rows", "K16", """SELECT CASE WHEN o_orderstatus = 'F' THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS market_id, CAST(o_custkey AS VARCHAR) AS exchange_id, CAST(o_orderkey AS VARCHAR) AS selection_id, o_totalprice AS confidence, o_orderpriority AS source FROM orders""")
def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("condition_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("event_id"),
        F.col("o_orderkey").alias("selection_id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("source"),
    )
    return sinks.mapping_rows(links)


@query("semantic_cache_ttl", "K14 T19 K03", """WITH o AS (SELECT lower('ask ' || CAST(o_custkey AS VARCHAR)) AS query, o_orderkey AS data, o_orderdate AS stamp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
 SELECT md5(query) AS hash, data FROM o WHERE rn = 1 AND epoch_us(TIMESTAMP '1998-08-02') - epoch_us(stamp) <= 86400000000 * 200""")
def semantic_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old answers, then new ones over them; what has outlived its time is no answer."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit(" Ask "), F.col("o_custkey").cast("string")).alias("query"), F.array(F.lit(1.0)).alias("embedding"), F.struct(F.col("o_orderkey").alias("data")).alias("data"), F.col("o_orderdate").alias("stamp"), "o_orderkey")
    latest = o.groupBy("query").agg(F.max_by(F.struct("embedding", "data", "stamp"), F.struct("stamp", "o_orderkey")).alias("x")).select("query", "x.*")
    first = o.groupBy("query").agg(F.min_by(F.struct("embedding", "data", "stamp"), F.struct("stamp", "o_orderkey")).alias("x")).select("query", "x.*")
    none = sinks.cache_put(first.limit(0).selectExpr("md5('') as hash", "*", "0D as ttl"), first, 86_400.0 * 200)
    live = sinks.cache_live(sinks.cache_put(none, latest, 86_400.0 * 200), F.lit("1998-08-02 00:00:00").cast("timestamp"))
    return live.select("hash", F.col("data.data").alias("data"))


@query("expired_rows", "K03", "SELECT o_orderkey FROM orders WHERE epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate) <= 86400000000 * 365")
def expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.expire(table(spark, sf_dir, "orders"), F.lit("1998-08-02 00:00:00").cast("timestamp"), 365 * 86_400.0, "o_orderdate").select("o_orderkey")


@query("trace_report", "K10", """WITH s AS (SELECT o_orderkey, o_orderstatus = 'F' AS ok, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
 SELECT '<section class=''' || CASE WHEN ok THEN 'pass' ELSE 'fail' END || '''><h2>T&amp;' || CAST(o_orderkey AS VARCHAR) || CASE WHEN ok THEN ' PASS' ELSE ' FAIL' END || '</h2><ol>'
 || string_agg('<li>&lt;' || CAST(l_partkey AS VARCHAR) || '&gt;</li>', '' ORDER BY l_linenumber, '<' || CAST(l_partkey AS VARCHAR) || '>') || '</ol></section>' AS value FROM s GROUP BY o_orderkey, ok""")
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landed(spark, "report")
    steps = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    steps = steps.select(F.concat(F.lit("T&"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderstatus") == "F").alias("passed"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("<"), F.col("l_partkey").cast("string"), F.lit(">")).alias("step"))
    sinks.trace_html(steps, path)
    return spark.read.text(path)


#: Slugs, competitions and regions that orders stand for, by remainders.
_SLUGS = ("nba-lakers", "ncaab-duke", "premier-league-arsenal", "la-liga-betis", "atp-rome", "mlb-mets")
_COMPETITIONS = ("", "NBA", "England Premier League", "LaLiga", "ATP Rome", "NCAA Division")
_PLACES = ("", "usa", "england", "spain")


def _pick(values: tuple[str, ...], key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _pick_sql(values: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


def _cross_sql() -> str:
    """P13 as SQL, one condition a rule."""
    has = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    either = lambda words: f"({has('slug', words)} OR {has('cat', words)})"
    bad = ["((contains(slug, 'ncaab') OR contains(slug, 'college-basketball')) AND contains(name, 'nba'))", "(contains(slug, 'nba') AND (contains(name, 'ncaa') OR contains(name, 'college basketball')))"]
    bad += [f"(sport = 'soccer' AND {has('slug', (k, *names))} AND comp <> '' AND NOT {has('comp', names)})" for k, names in predicates.LEAGUES.items()]
    bad += [f"(comp <> '' AND {either(words)} AND NOT {has('comp', words)})" for words in predicates.LEAGUE_WORDS.values()]
    bad += [f"(reg <> '' AND {either(words)} AND reg <> '{k}')" for k, words in predicates.REGION_WORDS.items()]
    return " OR ".join(bad)


@query("sport_cross_check", "P13", f"""WITH m AS (SELECT o_orderkey, {_pick_sql(_SLUGS, 'o_orderkey')} AS slug, lower(o_orderpriority) AS cat, lower({_pick_sql(_COMPETITIONS, 'o_custkey')}) AS name, lower({_pick_sql(_COMPETITIONS, 'o_custkey')}) AS comp,
 {_pick_sql(_PLACES, 'o_custkey')} AS reg, CASE WHEN o_orderkey % 6 IN (2, 3) THEN 'soccer' ELSE 'other' END AS sport FROM orders) SELECT o_orderkey, NOT ({_cross_sql()}) AS ok FROM m""")
def sport_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    competition = _pick(_COMPETITIONS, "o_custkey")
    sport = F.when((F.col("o_orderkey") % 6).isin(2, 3), "soccer").otherwise("other")
    ok = predicates.cross_check(_pick(_SLUGS, "o_orderkey"), F.col("o_orderpriority"), competition, competition, _pick(_PLACES, "o_custkey"), sport)
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("ok"))


_TAGS = ("politics", "games", "Crypto", "sports")


@query("viable_markets", "P20", f"""SELECT o_orderkey, {_pick_sql(('Soccer', 'politics', 'unknown'), 'o_custkey')} IN ('Soccer', 'unknown') AND {_pick_sql(_TAGS, 'o_orderkey')} IN ('games', 'sports') AS viable FROM orders""")
def viable_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", predicates.viable(_pick(("Soccer", "politics", "unknown"), "o_custkey"), F.array(_pick(_TAGS, "o_orderkey"), F.lit("live"))).alias("viable"))


@query("alert_gate", "P30", "SELECT l_orderkey, l_linenumber, l_discount * 100 AS edge FROM lineitem WHERE l_quantity >= 10 AND l_discount * 100 >= 3")
def alert_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("edge", F.col("l_discount") * 100)
    return rows.where(predicates.worth_alert(F.col("l_quantity") >= 10, F.col("edge"), 3.0)).select("l_orderkey", "l_linenumber", "edge")


@query("chase_ladder", "B06", f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity / 51 AS p, l_tax * 12 AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'LAY' ELSE 'BACK' END AS side FROM lineitem),
 d AS (SELECT *, CASE WHEN side = 'LAY' THEN b > p ELSE b < p END AS down FROM l), s AS (SELECT *, p * (1 + 0.5 / 100 * CASE WHEN down THEN -1 ELSE 1 END) AS p1 FROM d),
 s2 AS (SELECT *, p1 * (1 + 0.5 / 100 * CASE WHEN CASE WHEN side = 'LAY' THEN b > p1 ELSE b < p1 END THEN -1 ELSE 1 END) AS p2 FROM s),
 s3 AS (SELECT *, p2 * (1 + 0.5 / 100 * CASE WHEN CASE WHEN side = 'LAY' THEN b > p2 ELSE b < p2 END THEN -1 ELSE 1 END) AS p3 FROM s2),
 k AS (SELECT *, CASE WHEN side = 'LAY' THEN p1 > b ELSE p1 < b END AS w1, CASE WHEN side = 'LAY' THEN p2 > b ELSE p2 < b END AS w2, CASE WHEN side = 'LAY' THEN p3 > b ELSE p3 < b END AS w3 FROM s3)
 SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN w1 THEN 0 WHEN w2 THEN 1 WHEN w3 THEN 2 ELSE 3 END AS tries, {q('CASE WHEN w1 THEN NULL WHEN w2 THEN p1 WHEN w3 THEN p2 ELSE p3 END')} AS last FROM k""")
def chase_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "LAY").otherwise("BACK"))
    tried = risk.chase_prices(F.col("side"), F.col("l_quantity") / 51, F.col("l_tax") * 12)
    rows = rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", tried.alias("tried"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.size("tried").alias("tries"), quantise(F.try_element_at("tried", F.lit(-1))).alias("last"))


@query("price_chain", "J19", """SELECT o_orderkey AS market_id, o_custkey AS event_id, c_mktsegment AS event, min(l_extendedprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""")
def price_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    markets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("market_id"), F.col("o_custkey").alias("event_id"))
    events = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("event"))
    prices = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("market_id")).agg(F.min("l_extendedprice").alias("price"))
    return link.price_chain(markets, events, prices)


@query("name_cascade", "J10 J04", None)
def name_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of parts against part names; a test holds the stages to brute force."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" vs "), "p_brand")).otherwise(F.concat("p_name", F.lit(" final")))
    return link.name_cascade(part.select(k.alias("id"), name.alias("name")), part.select(k.alias("id"), F.lower("p_name").alias("name")))


@query("prop_name_match", "J09 X09", None)
def prop_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player props and titles of one statistic and line whose names fit; a test holds it to brute force."""
    part = table(spark, sf_dir, "part")
    both = lambda i: part.select(F.col("p_partkey").alias(i), F.col("p_type").alias("stat"), F.col("p_size").alias("line"), F.lower("p_name").alias("name"))
    return link.prop_match(both("prop_id").withColumnRenamed("name", "player"), both("title_id").withColumnRenamed("name", "title"))


@query("matcher_cascade", "X08 X09", None)
def matcher_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title against the title nine parts on; a test holds the rules to a plain version."""
    t = titles(spark, sf_dir)
    pairs = t.select("p_partkey", F.col("t").alias("a")).hint("merge").join(t.select((F.col("p_partkey") - 9).alias("p_partkey"), F.col("t").alias("b")), "p_partkey")
    return link.once(pairs, ["a", "b"], rule=link.static_match(F.col("a"), F.col("b"), "soccer")).select("p_partkey", "rule")


@query("event_groups", "S04", """SELECT 'e' || CAST(o_orderkey AS VARCHAR) AS event_id, o_orderpriority AS title, 'm' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS market_id, l_quantity / 51 AS price
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'""")
def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that land with their markets, the returned ones closed."""
    path = landed(spark, "event-groups")
    market_id = F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    token = F.struct(F.lit("Yes").alias("outcome"), (F.col("l_quantity") / 51).alias("price"), F.lit("t").alias("token_id"))
    market = F.struct(market_id.alias("id"), F.lit("q").alias("question"), (F.col("l_returnflag") == "R").alias("closed"), F.array(token).alias("tokens"))
    events = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(market).alias("markets"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), "o_orderkey")
    orders.join(events, F.col("o_orderkey") == F.col("l_orderkey")).select("id", "title", "markets").write.json(path)
    return readers.event_markets(spark, path).select("event_id", "title", "market_id", "price")


@query("grid_evaluator", "F02", f"SELECT o_orderkey, edge, pressure, {q('edge * pressure - 1')} AS profit FROM (SELECT o_orderkey, CAST(o_custkey % 7 AS DOUBLE) / 10 AS edge, o_totalprice / 1000 AS pressure FROM orders)")
def grid_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function over a table of settings."""
    grid = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7 / 10).alias("edge"), (F.col("o_totalprice") / 1000).alias("pressure"))
    out = stats.evaluate_grid(grid, lambda s: {"profit": s["edge"] * s["pressure"] - 1}, "o_orderkey long, edge double, pressure double, profit double")
    return out.withColumn("profit", quantise(F.col("profit")))


_NAMES = """na AS (SELECT p_partkey AS id, p_name AS t FROM part), nb AS (SELECT p_partkey AS id, p_brand || ' ' || p_name AS t FROM part), nc AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS t FROM part)"""


@query("fuzzy_all_pairs", "J07 X09", f"""WITH {_NAMES}, {scored_pairs('na', 'nb')} SELECT na.id AS left_id, nb.id AS right_id, (sort_score + set_score) / 2.0 AS score, (sort_score + set_score) / 2.0 > 75 AS good
 FROM scored JOIN na ON na.t = a JOIN nb ON nb.t = b WHERE (sort_score + set_score) / 2.0 > 60""")
def fuzzy_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts against all brands and names, with or without a shared word."""
    part = table(spark, sf_dir, "part")
    return link.fuzzy_pairs(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t")), part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name").alias("t")), share_word=False)


@query("hybrid_prefilter", "L04 X09", f"""WITH {_NAMES}, {scored_pairs('na', 'nc')}, p AS (SELECT a, nc.id AS right_id, greatest(set_score / 100.0, share) AS score FROM scored JOIN nc ON nc.t = b WHERE set_score >= 70 OR share >= 0.3 OR common > 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, right_id) AS INTEGER) AS rank FROM p) SELECT na.id AS left_id, right_id, score, rank FROM r JOIN na ON na.t = a WHERE rank <= 10""")
def hybrid_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten candidates of each name."""
    part = table(spark, sf_dir, "part")
    return link.hybrid_top(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t")), part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("t")))
