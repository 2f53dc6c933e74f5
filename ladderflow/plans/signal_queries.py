"""Queries over ordered ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators import signals as S
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import TICKS, q, quantise, ticks

W = "PARTITION BY key ORDER BY ts, seq"


@query("rolling_volatility", "W05", f"WITH {TICKS} SELECT seq, {q(f'CASE WHEN count(value) OVER w < 2 THEN 0.0 ELSE stddev_pop(value) OVER w END')} AS volatility FROM tick WINDOW w AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("seq", quantise(S.rolling_volatility(F.col("value"), S.by_key())).alias("volatility"))


@query("rolling_momentum", "W06", f"""WITH {TICKS}, m AS (SELECT seq, value, first_value(value) OVER w AS f, count(*) OVER w AS n FROM tick WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
 SELECT seq, {q('CASE WHEN n < 2 OR f = 0 THEN 0.0 ELSE (value - f) / f END')} AS momentum FROM m""")
def rolling_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("seq", quantise(S.momentum(F.col("value"), S.by_key())).alias("momentum"))


@query("mid_change", "W07 W14", f"""WITH {TICKS}, l AS (SELECT seq, value, lag(value) OVER ({W}) AS b FROM tick) SELECT seq, {q('value - coalesce(b, value)')} AS change,
 {q('CASE WHEN b > 0 THEN greatest(0.0, (value - b) / greatest(b, 0.1)) ELSE 0.0 END')} AS burst FROM l""")
def mid_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, w = F.col("value"), S.by_key()
    return ticks(spark, sf_dir).select("seq", quantise(S.change(v, w)).alias("change"), quantise(S.burst_ratio(v, w)).alias("burst"))


_FLOW = "CASE kind WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'error' THEN -1.0 ELSE -0.25 END * least(1.0, value / 100)"


@query("signed_flow", "W08 T23", f"WITH {TICKS}, f AS (SELECT seq, ts, key, {_FLOW} AS x FROM tick) SELECT seq, {q(f'greatest(-1.0, least(1.0, avg(x) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))) + 1e-9', 6)} AS shadow FROM f")
def signed_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    sign = F.when(kind == "purchase", 1.0).when(kind == "click", 0.5).when(kind == "error", -1.0).otherwise(-0.25)
    flow = sign * F.least(F.lit(1.0), F.col("value") / 100)
    return ticks(spark, sf_dir).withColumn("x", flow).select("seq", quantise(S.flow_mean(F.col("x"), S.by_key()) + 1e-9).alias("shadow"))


@query("since_last_fill", "W15", f"""WITH {TICKS}, l AS (SELECT seq, ts, max(CASE WHEN kind = 'purchase' THEN ts END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM tick)
 SELECT seq, {q("CAST(epoch_us(ts) - epoch_us(last) AS DOUBLE) / 1e6")} AS seconds FROM l""")
def since_last_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("seq", quantise(S.seconds_since(F.col("ts"), F.col("kind") == "purchase", S.by_key())).alias("seconds"))


@query("ewma_final", "W11", f"WITH {TICKS}, l AS (SELECT key, list(value ORDER BY ts, seq) AS vs FROM tick GROUP BY 1) SELECT key, {q('list_reduce(vs, lambda a, v: a * 0.8 + v * 0.2)')} AS ewma FROM l")
def ewma_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ewma(ticks(spark, sf_dir), "value", 0.2).withColumn("ewma", quantise(F.col("ewma")))


@query("drawdown_curve", "W09 W12", f"""WITH {TICKS}, e AS (SELECT seq, ts, key, 1000 + sum(value - 50) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM tick),
 p AS (SELECT *, max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM e) SELECT seq, {q('equity')} AS equity, {q('CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0.0 END')} AS drawdown FROM p""")
def drawdown_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.by_key()
    rows = ticks(spark, sf_dir).withColumn("equity", 1000 + F.sum(F.col("value") - 50).over(w.rowsBetween(-(2**63), 0)))
    return rows.select("seq", quantise(F.col("equity")).alias("equity"), quantise(S.running_drawdown(F.col("equity"), w)).alias("drawdown"))


@query("loss_streaks", "W10 T18", f"""WITH {TICKS}, i AS (SELECT *, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM tick)
 SELECT seq, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY key, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS streak FROM i""")
def loss_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.streaks(ticks(spark, sf_dir), F.col("value") < 50).select("seq", "streak")


@query("fee_prediction", "W13", f"""WITH {TICKS}, f AS (SELECT seq, ts, key, CAST(floor(value * 1000000) AS BIGINT) AS fee FROM tick), w AS (SELECT seq, fee, first_value(fee) OVER v AS f0, count(*) OVER v AS n FROM f WINDOW v AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
 SELECT seq, CASE WHEN n < 2 THEN fee ELSE least(fee + CAST(trunc((fee - f0) / CAST(n AS DOUBLE) * 0.5) AS BIGINT), fee + CAST(trunc(fee * CAST(0.125 AS DOUBLE)) AS BIGINT)) END AS predicted FROM w""")
def fee_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("fee", F.floor(F.col("value") * 1000000))
    return rows.select("seq", S.fee_prediction(F.col("fee"), S.by_key()).alias("predicted"))


_FEATURES = f"""{TICKS}, w AS (SELECT *, CASE WHEN count(*) OVER v < 2 THEN 0.0 ELSE stddev_pop(value) OVER v END / 1000 AS vol, lag(value) OVER ({W}) AS b FROM tick WINDOW v AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 x AS (SELECT seq, floor(vol * 1e6 + 0.5) / 1e6 AS vol, CASE WHEN b > 0 THEN floor((value - b) / b * 1e4 + 0.5) / 1e6 ELSE 0.0 END AS trend, value / (value + 60) AS buzz, CASE WHEN kind = 'click' THEN 0.6 ELSE -0.2 END AS shadow,
 CASE WHEN kind = 'purchase' THEN 0.7 ELSE 0.1 END AS pressure, (seq % 7 - 3) / 10.0 AS sent, 0.3 + (seq % 40) / 100.0 AS mid, value, seq % 11 AS pos FROM w)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.by_key()
    rows = ticks(spark, sf_dir).withColumn("vol", quantise(S.rolling_volatility(F.col("value"), w) / 1000)).withColumn("b", F.lag("value").over(w))
    return rows.select(
        "seq", "vol", F.when(F.col("b") > 0, F.floor((F.col("value") - F.col("b")) / F.col("b") * 1e4 + 0.5) / 1e6).otherwise(0.0).alias("trend"), (F.col("value") / (F.col("value") + 60)).alias("buzz"),
        F.when(F.col("kind") == "click", 0.6).otherwise(-0.2).alias("shadow"), F.when(F.col("kind") == "purchase", 0.7).otherwise(0.1).alias("pressure"),
        ((F.col("seq") % 7 - 3) / 10.0).alias("sent"), (0.3 + (F.col("seq") % 40) / 100.0).alias("mid"), "value", (F.col("seq") % 11).alias("pos"),
    )


_REGIME = """r AS (SELECT *, abs(trend) >= 0.01 * 1.5 AS drift, vol >= 0.02 * 1.5 OR abs(trend) >= 0.01 * 1.5 AS stressed, buzz >= 0.7 AS social, abs(shadow) >= 0.5 OR pressure >= 0.6 AS whale FROM x),
 g AS (SELECT *, CASE WHEN whale THEN 'whale-burst' WHEN social THEN 'social-buzz' WHEN stressed THEN CASE WHEN drift THEN 'drifting' ELSE 'volatile' END ELSE 'normal' END AS tag,
 greatest(CASE WHEN stressed THEN 0.3 ELSE 0.0 END, CASE WHEN social THEN CAST(0.3 AS DOUBLE) * 0.6 ELSE 0.0 END, CASE WHEN whale THEN CAST(0.3 AS DOUBLE) * 0.9 ELSE 0.0 END) AS widen,
 CASE WHEN social THEN sent * 0.3 ELSE 0.0 END + CASE WHEN whale THEN shadow * 0.5 ELSE 0.0 END AS lean FROM r)"""


def _regime(f: DataFrame) -> DataFrame:
    c = F.col
    return f.withColumn("r", S.regime(c("vol"), c("trend"), c("buzz"), c("sent"), c("shadow"), c("pressure"), 0.02, 0.01, 0.3))


@query("regime_tags", "P26 P27", f"""WITH {_FEATURES}, {_REGIME} SELECT seq, tag, {q('widen')} AS widen, {q('lean')} AS lean,
 CASE WHEN vol >= 0.02 * 2.5 AND abs(trend) >= 0.01 * 2 THEN 'volatility_and_trend' WHEN vol >= 0.02 * 2.5 THEN 'volatility' WHEN abs(trend) >= 0.01 * 2 THEN 'trend' END AS pause FROM g""")
def regime_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regime(_features(spark, sf_dir))
    return rows.select("seq", F.col("r.tag").alias("tag"), quantise(F.col("r.widen")).alias("widen"), quantise(F.col("r.lean")).alias("lean"), S.pause_reason(F.col("vol"), F.col("trend"), 0.02, 0.01).alias("pause"))


@query("opportunity_scores", "Y25 L10 Y19", f"""WITH {_FEATURES}, {_REGIME}, h AS (SELECT *, floor((0.5 * least(1.0, (0.01 + buzz / 50) / 0.02) + 0.25 * abs(sent) + 0.08 * abs(trend) + 0.07 * least(1.0, vol / 0.02) + 0.07 * (CASE WHEN buzz <= 0.2 THEN 1 ELSE 0 END)
 + 0.08 * least(1.0, abs(trend) / 0.01) + 0.05 * (1 - buzz) + 0.05 * abs(sent) + 0.05 * buzz + 0.05 * pressure + 0.06 * abs(shadow) + 0.05 * (CASE WHEN tag <> 'normal' THEN 1 ELSE 0 END)) * 1000 + 0.5) / 1000 AS heur,
 least(0.95, 0.35 * greatest(0.2, buzz) * CASE WHEN pressure >= 0.55 THEN 1.2 ELSE 0.6 END) AS wt FROM g), s AS (SELECT seq, tag, floor(least(1.0, heur * (1 - wt) + 1 / (1 + exp(-(sent * 4))) * wt) * 1000 + 0.5) / 1000 AS score FROM h)
 SELECT seq, tag, score FROM s WHERE score >= 0.6""")
def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _regime(_features(spark, sf_dir))
    ml = 1 / (1 + F.exp(-(c("sent") * 4)))
    score = S.opportunity_score(0.01 + c("buzz") / 50, c("sent"), c("trend"), c("vol"), c("buzz") <= 0.2, c("trend"), c("buzz"), c("sent"), c("buzz"), c("pressure"), c("shadow"), c("r.tag"), ml, c("buzz"))
    return rows.select("seq", c("r.tag").alias("tag"), score.alias("score")).where("score >= 0.6")


_QUOTE = """h0 AS (SELECT *, CASE WHEN (mid + 0.03) - (mid - 0.02) >= 0.05 THEN least(greatest(0.001, CAST(0.02 AS DOUBLE) / 2), ((mid + 0.03) - (mid - 0.02)) * 0.8 / 2) ELSE greatest(0.001, CAST(0.02 AS DOUBLE) / 2) END AS h FROM g),
 h1 AS (SELECT *, CASE WHEN vol > 0.02 THEN h * (1 + least(3.0, (vol - 0.02) / 0.02) * 0.15) ELSE h END * (1 + 0.1 * buzz) * (1 + 0.2 * pressure) * (1 + 0.1 * abs(shadow)) * (1 + widen) AS half FROM h0),
 h2 AS (SELECT *, sent * 0.5 * half * 0.5 + shadow * half * 0.35 + lean * half * 0.5 - sent * 0.5 * half - trend * 0.8 * half - pos * 0.0001 AS lift FROM h1),
 h3 AS (SELECT *, floor((mid - half + lift) * 1000 + 0.5) / 1000 AS b, floor((mid + half + lift) * 1000 + 0.5) / 1000 AS a FROM h2)"""


@query("quotes", "Y24", f"""WITH {_FEATURES.replace("/ 10.0 AS sent", "/ CAST(10 AS DOUBLE) AS sent").replace("0.3 + (seq % 40) / 100.0 AS mid", "CAST(0.3 AS DOUBLE) + (seq % 40) / CAST(100 AS DOUBLE) AS mid")}, {_REGIME}, {_QUOTE}
 SELECT seq, {q('CASE WHEN b > 0 AND a < 1 AND b < a THEN least(b, mid + 0.03 - 0.001) END', 4)} AS bid, {q('CASE WHEN b > 0 AND a < 1 AND b < a THEN greatest(a, mid - 0.02 + 0.001) END', 4)} AS ask FROM h3""")
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes around the mid; tests hold known books against the rules."""
    c = F.col
    rows = _regime(_features(spark, sf_dir))
    made = S.quote(c("mid"), c("mid") - 0.02, c("mid") + 0.03, c("sent"), c("vol"), c("trend"), c("buzz"), c("sent"), c("pressure"), c("shadow"), c("r.widen"), c("r.lean"), c("pos"))
    return rows.select("seq", made.alias("quote")).select("seq", quantise(F.col("quote.bid"), 4).alias("bid"), quantise(F.col("quote.ask"), 4).alias("ask"))


@query("quote_crossing_fills", "B05", f"""WITH {TICKS}, l AS (SELECT seq, key, value, lag(value) OVER ({W}) AS b FROM tick) SELECT seq, CASE WHEN value <= b - 10 THEN 'BUY' WHEN value >= b + 10 THEN 'SELL' END AS fill FROM l WHERE abs(value - b) >= 10""")
def quote_crossing_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ask at or below the earlier bid of ours buys, a bid at or above the earlier ask sells; quotes stand 10 away."""
    before = F.lag("value").over(S.by_key())
    rows = ticks(spark, sf_dir).withColumn("b", before).where(F.abs(F.col("value") - F.col("b")) >= 10)
    return rows.select("seq", F.when(F.col("value") <= F.col("b") - 10, "BUY").when(F.col("value") >= F.col("b") + 10, "SELL").alias("fill"))


_TELEMETRY = f"""{TICKS}, l AS (SELECT key, list(value ORDER BY ts, seq) AS vs, list(CAST(CASE WHEN value >= 50 THEN 1 ELSE 0 END AS DOUBLE) ORDER BY ts, seq) AS hs, count(*) AS n FROM tick GROUP BY 1),
 e AS (SELECT key, floor(list_reduce(vs, lambda a, v: a * 0.7 + v * 0.3) * 1e6 + 0.5) / 1e6 AS v, floor(list_reduce(hs, lambda a, v: a * 0.7 + v * 0.3) * 1e6 + 0.5) / 1e6 AS h, n FROM l)"""


@query("execution_health", "Y26 A22", f"""WITH {_TELEMETRY}, t AS (SELECT key, h AS win, v * 8 AS lat, v / 2000 AS slip, h AS fill, n % 5 AS streak FROM e),
 a AS (SELECT *, concat_ws(',', CASE WHEN lat >= 900 THEN 'latency' END, CASE WHEN streak >= 4 THEN 'loss_streak' END, CASE WHEN slip >= 0.05 THEN 'slippage' END) AS halts,
 concat_ws(',', CASE WHEN lat >= 350 THEN 'latency' END, CASE WHEN slip >= 0.02 THEN 'slippage' END, CASE WHEN win < 0.45 THEN 'win_rate' END) AS warns FROM t)
 SELECT key, CASE WHEN halts <> '' THEN 'halt' WHEN warns <> '' THEN 'degraded' ELSE 'healthy' END AS status, CASE WHEN halts <> '' THEN halts ELSE warns END AS reason,
 CASE WHEN halts <> '' THEN 0.0 WHEN warns <> '' THEN 0.7 ELSE 1.0 END AS size,
 {q('''greatest(-0.2, least(0.4, -(CASE WHEN fill > 0.6 AND slip <= 0.01 THEN least(0.15, (fill - 0.6) / 0.6 * 0.1) ELSE 0.0 END) + (CASE WHEN fill < CAST(0.6 AS DOUBLE) * 0.6 THEN 0.08 ELSE 0.0 END)
 + (CASE WHEN slip > 0.02 THEN least(0.3, (slip - 0.02) / 0.02 * 0.05) ELSE 0.0 END) + (CASE WHEN lat > 350 THEN 0.05 ELSE 0.0 END) + (CASE WHEN slip > 0.01 THEN 0.06 ELSE 0.0 END)))''', 5)} AS widen FROM a""")
def execution_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ticks(spark, sf_dir).withColumn("hit", F.when(F.col("value") >= 50, 1.0).otherwise(0.0))
    v = S.ewma(base, "value", 0.3).withColumnRenamed("ewma", "v")
    h = S.ewma(base, "hit", 0.3).withColumnRenamed("ewma", "h")
    n = base.groupBy("key").agg(F.count("*").alias("n"))
    rows = v.join(h, "key").join(n, "key").withColumn("v", quantise(F.col("v"))).withColumn("h", quantise(F.col("h")))
    slip, latency = F.col("v") / 2000, F.col("v") * 8
    health = S.execution_health(F.col("h"), latency, slip, F.col("n") % 5)
    adjust = S.adjustment(F.col("h"), slip, slip, latency)
    return rows.select("key", health["status"].alias("status"), health["reason"].alias("reason"), health["size"].alias("size"), quantise(adjust["widen"], 5).alias("widen"))


@query("latest_price_join", "J18 T04", f"""WITH {TICKS}, s AS (SELECT seq, ts, seq % 40 AS mapping, CASE WHEN kind IN ('view', 'click') THEN 'A' ELSE 'B' END AS side, value FROM tick),
 l AS (SELECT seq, mapping, last_value(CASE WHEN side = 'A' THEN value END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN side = 'B' THEN value END IGNORE NULLS) OVER w AS b FROM s
 WINDOW w AS (PARTITION BY mapping ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) SELECT seq, mapping, a, b, {q('a - b')} AS gap FROM l WHERE a IS NOT NULL AND b IS NOT NULL""")
def latest_price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of two venues: each tick meets the last price of the other side."""
    rows = ticks(spark, sf_dir).withColumn("mapping", F.col("seq") % 40).withColumn("side", F.when(F.col("kind").isin("view", "click"), "A").otherwise("B"))
    w = S.by_key("mapping").rowsBetween(-(2**63), 0)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("value")), ignorenulls=True).over(w)
    return rows.select("seq", "mapping", last("A").alias("a"), last("B").alias("b")).where("a is not null and b is not null").withColumn("gap", quantise(F.col("a") - F.col("b")))


@query("verification_after_15m", "T05 P28 Y22", f"""WITH {TICKS}, o AS (SELECT seq, key, ts, value FROM tick WHERE kind = 'purchase'), m AS (SELECT o.seq, o.value, arg_min(t.value, (t.ts, t.seq)) AS later FROM o
 JOIN tick t ON t.key = o.key AND t.ts >= o.ts + INTERVAL 15 MINUTE AND t.ts < o.ts + INTERVAL 10 DAY GROUP BY 1, 2)
 SELECT seq, {q('abs(later - value) / value')} AS drift, CASE WHEN abs(later - value) / value > 0.3 THEN 'HIGH_VOLATILITY_RISK' ELSE 'DATA_LOGGED' END AS label FROM m WHERE value > 0""")
def verification_after_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first price at least 15 minutes later decides the label. Done on the union by one ordered window, not by a
    range join: the next tick of the key beyond the delay."""
    t = ticks(spark, sf_dir)
    o = t.where("kind = 'purchase' and value > 0").select("key", "seq", "value", F.col("ts").alias("t0"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    probes = o.select("key", (micros("t0") + 900_000_000).alias("at"), F.lit(0).alias("tick"), "seq", F.col("value").alias("v"))
    both = probes.unionByName(t.select("key", micros("ts").alias("at"), F.lit(1).alias("tick"), "seq", F.col("value").alias("v")))
    ahead = S.Window.partitionBy("key").orderBy("at", "tick", "seq").rowsBetween(1, 2**63 - 1)
    nxt = F.first(F.when(F.col("tick") == 1, F.struct("at", "v")), ignorenulls=True).over(ahead)
    hit = both.withColumn("n", nxt).where("tick = 0 and n is not null").where(F.col("n.at") < F.col("at") + (864_000 - 900) * 1_000_000)
    drift = F.abs(F.col("n.v") - F.col("v")) / F.col("v")
    return hit.select("seq", quantise(drift).alias("drift"), F.when(drift > 0.3, "HIGH_VOLATILITY_RISK").otherwise("DATA_LOGGED").alias("label"))
