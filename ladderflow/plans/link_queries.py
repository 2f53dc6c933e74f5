"""Queries of record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.functions import fuzzy, predicates
from ladderflow.functions import text as T
from ladderflow.operators import link
from ladderflow.plans.catalog import query
from ladderflow.plans.fuzzy_sql import scored_pairs
from ladderflow.plans.proxies import q, quantise, spread, table
from ladderflow.plans.text_queries import _BASE, _LINE_SQL, _SPEC, _TYPE, TITLES, _structure_sql, titles

EVENTS = """ev AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts, CASE WHEN o_custkey % 11 = 0 THEN 'global' ELSE 'r' || CAST(o_custkey % 5 AS VARCHAR) END AS region, o_orderstatus AS status FROM orders),
 l AS (SELECT * FROM ev WHERE status = 'F'), r AS (SELECT * FROM ev WHERE status <> 'F')"""


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * 3_600_000_000)
    region = F.when(F.col("o_custkey") % 11 == 0, "global").otherwise(F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")))
    ev = orders.select(F.col("o_orderkey").alias("id"), ts.alias("ts"), region.alias("region"), F.col("o_orderstatus").alias("status"))
    return ev.where("status = 'F'"), ev.where("status <> 'F'")


_BAND = f"""{EVENTS}, j AS (SELECT l.id AS left_id, r.id AS right_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS gap FROM l JOIN r ON (l.region = r.region OR r.region = 'global')
 AND r.ts > l.ts - INTERVAL 24 HOUR AND r.ts < l.ts + INTERVAL 24 HOUR)"""


@query("band_join_24h", "J01 J02 J03 P06", f"WITH {_BAND} SELECT left_id, right_id, CAST(gap AS BIGINT) AS gap FROM j")
def band_join_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.band_join(*_events(spark, sf_dir))


@query("blocked_first_match", "J02 F08", f"WITH {_BAND}, k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, right_id) AS rn FROM j) SELECT left_id, right_id, CAST(gap AS BIGINT) AS gap FROM k WHERE rn = 1")
def blocked_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.nearest_match(*_events(spark, sf_dir))


@query("unmatched_antijoin", "J13", f"WITH {_BAND} SELECT id FROM l WHERE id NOT IN (SELECT left_id FROM j)")
def unmatched_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _events(spark, sf_dir)
    return left.select("id").join(link.nearest_match(left, right).select(F.col("left_id").alias("id")), "id", "left_anti")


#: The distinct words of whole texts and the pairs that share some, in SQL.
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
_TOKENS = f"""d AS (SELECT doc_id AS id, {_WORDS} AS tokens FROM documents), b AS (SELECT item_id AS id, {_WORDS} AS tokens FROM benchmark),
 p AS (SELECT bt.id AS left_id, dt.id AS right_id, count(*) AS common, count(*) FILTER (WHERE length(t) > 3) AS long FROM (SELECT id, unnest(tokens) AS t FROM b) bt JOIN (SELECT id, unnest(tokens) AS t FROM d) dt USING (t) GROUP BY 1, 2)"""


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All distinct words of both sides."""
    words = F.array_distinct(T.words(F.lower("text")))
    side = lambda t, k: spread(table(spark, sf_dir, t)).select(F.col(k).alias("id"), words.alias("tokens"))
    return side("benchmark", "item_id"), side("documents", "doc_id")


@query("token_join_min2", "J08 J12", f"WITH {_TOKENS} SELECT left_id, right_id, common FROM p WHERE common >= 2 AND long >= 1")
def token_join_min2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 shared words, one of them longer than 3."""
    return link.token_pairs(*_tokens(spark, sf_dir)).select("left_id", "right_id", "common")


@query("jaccard_topk", "L03 U04", f"""WITH {_TOKENS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY left_id ORDER BY common DESC, right_id) AS INTEGER) AS rank FROM p)
 SELECT left_id, right_id, common, {q('CAST(common AS DOUBLE) / (len(b.tokens) + len(d.tokens) - common)')} AS jaccard, rank FROM k JOIN b ON b.id = left_id JOIN d ON d.id = right_id WHERE rank <= 3""")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.jaccard_top(*_tokens(spark, sf_dir)).withColumn("jaccard", quantise(F.col("jaccard")))


_ALIASES = """al AS (SELECT 's' || CAST(p_partkey % 3 AS VARCHAR) AS sport, p_name AS alias, p_brand AS canonical, p_partkey AS version FROM part),
 la AS (SELECT sport, lower(alias) AS alias_lc, arg_max(canonical, version) AS canonical FROM al GROUP BY 1, 2)"""


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("sport"), F.col("p_name").alias("alias"), F.col("p_brand").alias("canonical"), F.col("p_partkey").alias("version"))


@query("dictionary_resolve", "J14 X22", f"""WITH {_ALIASES}, n AS (SELECT p_partkey AS id, 's' || CAST(p_partkey % 3 AS VARCHAR) AS sport, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) || ' x' ELSE ' ' || upper(p_name) END AS name FROM part)
 SELECT id, n.sport, name, canonical FROM n LEFT JOIN la ON n.sport = la.sport AND lower(trim(name)) = alias_lc""")
def dictionary_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.upper("p_name"), F.lit(" x"))).otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    names = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("sport"), name.alias("name"))
    return link.resolve_exact(names, _aliases(spark, sf_dir)).select("id", "sport", "name", "canonical")


@query("fuzzy_dictionary", "J16 X09", None)
def fuzzy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("sport"), F.concat("p_name", F.lit("s")).alias("name"))
    aliases = _aliases(spark, sf_dir).groupBy("sport", "alias").agg(F.max("canonical").alias("canonical"), F.max("version").alias("version"))
    return link.resolve_fuzzy(names, aliases)


@query("substring_dictionary", "J15 P15", f"""WITH {TITLES}, a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS alias, upper(split_part(p_name, ' ', 2)) AS canonical FROM part),
 h AS (SELECT p_partkey AS id, list_sort(list(DISTINCT canonical)) AS c FROM title, a WHERE length(alias) >= 3 AND list_contains(regexp_split_to_array(lower(t), '\\s+'), alias) GROUP BY 1) SELECT id, array_to_string(c, ',') AS canonicals FROM h""")
def substring_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.split("p_name", " "), F.lit(1))
    aliases = table(spark, sf_dir, "part").select(F.lower(word).alias("alias"), F.upper(word).alias("canonical")).distinct()
    texts = spread(titles(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("t").alias("text")))
    return link.mentioned(texts, aliases).select("id", F.array_join("canonicals", ",").alias("canonicals"))


@query("two_sided_overlap", "P14 P15", None)
def two_sided_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring titles against each other; known pairs are held in a test."""
    a = titles(spark, sf_dir).select("p_partkey", F.col("t").alias("a"))
    b = titles(spark, sf_dir).select((F.col("p_partkey") - 9).alias("p_partkey"), F.col("t").alias("b"))
    none = F.array().cast("array<string>")
    rows = a.hint("merge").join(b, "p_partkey")
    guard = link.guardrail(F.col("a"), F.col("b"), none, none)
    done = link.once(rows, ["a", "b"], fits=link.overlap(F.col("a"), F.col("b"), "soccer"), reason=guard["reason"], rule=link.static_match(F.col("a"), F.col("b")))
    return done.select("p_partkey", "fits", "reason", "rule")


@query("fuzzy_best_match", "J05 J06 L09 X09 X10", None)
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and hybrid score of each title among all others that share a word and a type."""
    t = titles(spark, sf_dir).select(F.col("p_partkey").alias("id"), T.normalize_title(F.col("t")).alias("t"), T.market_type(F.col("t")).alias("kind"))
    scored = link.best_fuzzy(t).where("score > 50")
    return scored.withColumn("hybrid", fuzzy.hybrid_score(F.col("set_score"), F.lit(None).cast("boolean")))


_DATED = """l AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 7 > 0 THEN '2024-01-0' || CAST(p_partkey % 5 + 1 AS VARCHAR) || 'T10:00:00' ELSE '' END AS da FROM part),
 r AS (SELECT p_partkey - 9 AS p_partkey, p_brand || ' ' || p_name AS b, CASE WHEN p_partkey % 11 > 0 THEN '2024-01-0' || CAST(p_partkey % 3 + 1 AS VARCHAR) END AS db FROM part)"""


@query("hybrid_scores", "X10 X09", f"""WITH {_DATED}, {scored_pairs('(SELECT a AS t FROM l)', '(SELECT b AS t FROM r)')} SELECT l.p_partkey, {q('set_score * 0.7 + CASE WHEN coalesce(da, %s) = %s OR coalesce(db, %s) = %s THEN 50 WHEN substr(da, 1, 10) = substr(db, 1, 10) THEN 100 ELSE 0 END * 0.3' % (("''",) * 4))} AS score
 FROM l JOIN r USING (p_partkey) JOIN scored s ON s.a = l.a AND s.b = r.b""")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and dates of each part against the part nine on: token-set ratio, and whether the days are equal, different or unknown."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    day = lambda n: F.concat(F.lit("2024-01-0"), (k % n + 1).cast("string"))
    left = part.select("p_partkey", F.col("p_name").alias("a"), F.when(k % 7 > 0, F.concat(day(5), F.lit("T10:00:00"))).otherwise("").alias("da"))
    right = part.select((k - 9).alias("p_partkey"), F.concat_ws(" ", "p_brand", "p_name").alias("b"), F.when(k % 11 > 0, day(3)).alias("db"))
    score = fuzzy.hybrid_score(fuzzy.set_ratio_column(F.col("a"), F.col("b")), fuzzy.same_day(F.col("da"), F.col("db")))
    return left.join(right, "p_partkey").select("p_partkey", quantise(score).alias("score"))


@query("triangle_links", "J11", """WITH ab AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linestatus = 'O'), bc AS (SELECT DISTINCT l_partkey AS b, l_suppkey AS c FROM lineitem WHERE l_returnflag = 'R')
 SELECT a, b, c FROM ab JOIN bc USING (b)""")
def triangle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    ab = line.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    bc = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c")).distinct()
    return link.triangle(ab, bc)


@query("outcome_keyword_search", "P22 S05", """SELECT DISTINCT l_orderkey AS market_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'red')""")
def outcome_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").where(F.lower("p_name").contains("red")).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(named, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("market_id")).distinct()


@query("prop_join", "Y34", """WITH b AS (SELECT o_orderkey AS prop_id, CAST(o_orderkey % 7 AS VARCHAR) AS stat, o_custkey % 40 AS line FROM orders WHERE o_orderstatus = 'F'),
 p AS (SELECT p_partkey, CAST(p_partkey % 7 AS VARCHAR) AS stat, p_size AS line FROM part) SELECT prop_id, p_partkey FROM b JOIN p USING (stat, line)""")
def prop_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player props meet by statistic and line; names are then compared by the fuzzy operators."""
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("prop_id"), (F.col("o_orderkey") % 7).cast("string").alias("stat"), (F.col("o_custkey") % 40).alias("line"))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).cast("string").alias("stat"), F.col("p_size").cast("long").alias("line"))
    return link.dealt_pairs(b, p, ["stat", "line"], "prop_id", "p_partkey")


def _type_sql() -> str:
    """P09 to P11 for pairs of titles a and b, from the SQL twins of the text rules."""
    kind = lambda x: _BASE.replace("x,", f"lower({x}),")
    line = lambda x: _LINE_SQL.format(x=f"lower({x})")
    sides = {n: _structure_sql(f"lower({n})") for n in "ab"}
    spec = lambda x: f"TRY_CAST(nullif(regexp_extract({x}, '{_SPEC}', 2), '') AS DOUBLE)"
    return f"""WITH {TITLES}, p AS (SELECT l.p_partkey, l.t AS a, r.t AS b FROM title l JOIN title r ON r.p_partkey = l.p_partkey + 9),
 k AS (SELECT *, {kind('a')} AS ka, CASE {kind('b')} WHEN 'TOTALS' THEN 'OVER_UNDER_25' WHEN 'SPREAD' THEN 'ASIAN_HANDICAP' ELSE 'MATCH_ODDS' END AS mt, {_TYPE.replace('(t)', '(a)')} AS ta FROM p)
 SELECT p_partkey, CASE ka WHEN 'TOTALS' THEN mt = 'OVER_UNDER_25' WHEN 'SPREAD' THEN mt = 'ASIAN_HANDICAP' WHEN 'BTTS' THEN false ELSE mt = 'MATCH_ODDS' END
 AND CASE WHEN ka IN ('TOTALS', 'SPREAD') THEN coalesce(abs({line('a')} - {line('b')}) <= 0.01, false) ELSE true END AS types,
 {sides['a']['scope']} = {sides['b']['scope']} AND {sides['a']['kind']} = {sides['b']['kind']} AND ({sides['a']['kind']} <> 'player_prop' OR {sides['a']['subtype']} = {sides['b']['subtype']}) AS structures,
 CASE WHEN ta = 'TOTALS' OR contains(lower(b), 'over') OR contains(lower(b), 'under') THEN coalesce({spec('a')} = {spec('b')}, false) WHEN ta = 'DRAW' THEN contains(lower(b), 'draw') OR contains(lower(b), 'tie') ELSE true END AS totals FROM k"""


@query("type_compatibility", "P09 P10 P11 X17", _type_sql())
def type_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title against the title nine parts on (which has its form); known pairs are held in a test."""
    a = titles(spark, sf_dir).select("p_partkey", F.col("t").alias("a"))
    b = titles(spark, sf_dir).select((F.col("p_partkey") - 9).alias("p_partkey"), F.col("t").alias("b"))
    kind = F.when(T.base_type(F.col("b")) == "TOTALS", "OVER_UNDER_25").when(T.base_type(F.col("b")) == "SPREAD", "ASIAN_HANDICAP").otherwise("MATCH_ODDS")
    x, y = F.col("a"), F.col("b")
    return a.join(b, "p_partkey").select("p_partkey", predicates.compatible_types(x, kind, y).alias("types"), predicates.compatible_structures(x, y).alias("structures"), predicates.compatible_totals(x, F.lit("Yes"), y).alias("totals"))
