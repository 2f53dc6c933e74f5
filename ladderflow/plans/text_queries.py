"""Queries over titles and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.functions import text as T
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import q, quantise, table

#: A title for each part, in SQL that both engines read.
TITLE = """CASE p_partkey % 9 WHEN 0 THEN 'Will ' || p_name || ' FC win?' WHEN 1 THEN p_name || ' vs ' || p_type WHEN 2 THEN p_name || ' Over ' || p_size || '.5 points'
 WHEN 3 THEN 'NBA: 1st half ' || p_name || ' Under ' || p_size WHEN 4 THEN 'Draw: ' || p_name || ' vs. ' || p_type || ' City' WHEN 5 THEN upper(p_name) || ' spread -' || p_size || '.5'
 WHEN 6 THEN p_name || ' first td scorer' WHEN 7 THEN 'Both teams to score - ' || p_name || ' United 2nd half' ELSE 'Total ' || p_name || ' v ' || p_brand || ' o/u 3.5' END"""
TITLES = f"title AS (SELECT p_partkey, p_name, p_size, {TITLE} AS t FROM (SELECT p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size, p_brand, p_type FROM part))"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("string"))
    return part.select("p_partkey", "p_name", "p_size", F.expr(TITLE).alias("t"))


def _list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def _holds(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _clean_sql(x: str) -> str:
    low = f"regexp_replace(trim(lower({x})), '{'|'.join(T.NOISE)}', '', 'g')"
    for suffix in T.SUFFIXES:
        low = f"regexp_replace({low}, '\\s+{suffix}$', '', 'g')"
    return f"trim(regexp_replace({low}, '[^a-zA-Z0-9\\s]', '', 'g'))"





@query("normalize_titles", "X01 X05", f"""WITH {TITLES} SELECT p_partkey, array_to_string(list_filter({_words("regexp_replace(lower(t), '[^a-z\\s]', '', 'g')")}, lambda w: w NOT IN {_list(T.LEGACY_STOP)}), ' ') AS normal,
 trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS collapsed FROM title""")
def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", T.normalize_title(F.col("t")).alias("normal"), T.collapse(F.col("t")).alias("collapsed"))


@query("clean_tokens", "X02 X03", f"""WITH {TITLES}, c AS (SELECT p_partkey, t, {_clean_sql('t')} AS name FROM title) SELECT p_partkey, name,
 array_to_string(list_sort(list_distinct(list_filter({_words('name')}, lambda w: w NOT IN {_list(T.CLEAN_STOP)} AND length(w) >= 2))), ' ') AS tokens,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(t), '\\w+'), lambda w: w NOT IN {_list(T.SEARCH_STOP)} AND length(w) > 2))), ' ') AS search FROM c""")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return titles(spark, sf_dir).select("p_partkey", T.clean_name(t).alias("name"), F.array_join(T.clean_tokens(t), " ").alias("tokens"), F.array_join(T.search_tokens(t), " ").alias("search"))


@query("alias_explode", "X11 K12 S32", """WITH a AS (SELECT p_partkey, p_name, string_split(lower(trim(p_name)), ' ') AS w FROM part), e AS (SELECT p_partkey, unnest(CASE WHEN len(w) = 2 AND length(w[2]) > 1
 THEN [p_name, w[1][1] || '. ' || w[2], w[2] || ', ' || w[1][1] || '.', w[1][1] || ' ' || w[2], w[2]] ELSE [p_name] END) AS alias FROM a) SELECT DISTINCT p_partkey, alias FROM e""")
def alias_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.person_aliases(F.col("p_name"))).alias("alias"))


@query("versus_split", "X04", f"""WITH {TITLES}, s AS (SELECT p_partkey, t, list_transform(regexp_split_to_array(t, ' vs\\.? | v | @ '), lambda x: trim(x)) AS p FROM title)
 SELECT p_partkey, unnest(CASE WHEN len(p) = 2 AND length(p[1]) > 2 AND length(p[2]) > 2 THEN [t, p[1], p[2]] ELSE [t] END) AS candidate FROM s""")
def versus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", F.explode(T.split_versus(F.col("t"))).alias("candidate"))


_LINE_SQL = "TRY_CAST(list_extract(regexp_extract_all({x}, '[+-]?\\d+\\.?\\d*'), -1) AS DOUBLE)"


@query("line_value", "X12", f"WITH {TITLES} SELECT p_partkey, {_LINE_SQL.format(x='t')} AS line FROM title")
def line_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", T.line_value(F.col("t")).alias("line"))


def _structure_sql(x: str) -> dict[str, str]:
    h = lambda *p: _holds(x, p)
    td = h("touchdown", "td")
    return {
        "scope": f"CASE WHEN {h('1h', '1st half', 'first half')} THEN 'h1' WHEN {h('2h', '2nd half')} THEN 'h2' WHEN {h('q1', '1st quarter')} THEN 'q1' WHEN {h('set 1')} THEN 'set1' ELSE 'full' END",
        "kind": f"CASE WHEN {td} OR {h('rebound', 'assist', 'point')} THEN 'player_prop' WHEN {h('spread', 'handicap')} THEN 'spread' WHEN {h('total', 'over', 'under')} THEN 'total' ELSE 'moneyline' END",
        "subtype": f"CASE WHEN {td} THEN CASE WHEN {h('first')} THEN 'first_td' ELSE 'anytime_td' END WHEN {h('rebound')} THEN 'rebounds' WHEN {h('assist')} THEN 'assists' WHEN {h('point')} THEN 'points' ELSE 'main' END",
        "entity": f"CASE WHEN {td} OR {h('rebound', 'assist', 'point')} THEN 'player' ELSE 'match' END",
    }


@query("market_structure", "X13", f"WITH {TITLES}, l AS (SELECT p_partkey, lower(t) AS x FROM title) SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in _structure_sql('x').items())} FROM l")
def market_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", T.structure(F.col("t")).alias("s")).select("p_partkey", "s.*")


_BASE = f"CASE WHEN {_holds('x', T.TOTAL_WORDS)} THEN 'TOTALS' WHEN {_holds('x', T.SPREAD_WORDS)} THEN 'SPREAD' WHEN {_holds('x', T.BOTH_SCORE_WORDS)} THEN 'BTTS' WHEN {_holds('x', ('draw', 'empate'))} THEN 'DRAW' ELSE 'WINNER' END"


@query("market_fingerprint", "X14 F04", f"""WITH {TITLES}, l AS (SELECT p_partkey, lower(t) AS x FROM title), b AS (SELECT *, {_BASE} AS base, {_LINE_SQL.format(x='x')} AS line,
 CASE WHEN {_holds('x', ('1h', '1st half', 'primer tiempo', 'first half'))} THEN 'first_half' WHEN {_holds('x', ('2h', '2nd half', 'second half', 'segundo tiempo'))} THEN 'second_half'
 WHEN {_holds('x', ('quarter', 'q1', 'q2'))} THEN 'quarter' ELSE 'full_time' END AS period FROM l)
 SELECT p_partkey, concat_ws(':', base, CASE WHEN base IN ('TOTALS', 'SPREAD') THEN CAST(line AS VARCHAR) END, period) AS fingerprint FROM b""")
def market_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", T.fingerprint(F.col("t"), F.lit("")).alias("fingerprint"))


_TYPE = r"""CASE WHEN regexp_matches(lower(t), '\b(draw|tie|empate)\b') THEN 'DRAW' WHEN regexp_matches(lower(t), '(over|under|o/u)\s*(\d+(?:\.\d+)?)') THEN 'TOTALS'
 WHEN contains(lower(t), 'win') OR contains(lower(t), 'victory') OR contains(lower(t), 'to beat') OR contains(lower(t), 'champion') THEN 'MATCH_WINNER' ELSE 'UNKNOWN' END"""
_SPEC = r"(?i)(over|under|o/u)\s*(\d+(?:\.\d+)?)"


@query("market_types", "X15", f"""WITH {TITLES} SELECT p_partkey, {_TYPE} AS kind, CASE WHEN regexp_matches(t, '{_SPEC}') THEN CASE WHEN upper(regexp_extract(t, '{_SPEC}', 1)) = 'OVER' THEN 'OVER' ELSE 'UNDER' END END AS side,
 TRY_CAST(nullif(regexp_extract(t, '{_SPEC}', 2), '') AS DOUBLE) AS line FROM title""")
def market_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return titles(spark, sf_dir).select("p_partkey", T.market_type(t).alias("kind"), T.totals_spec(t)["side"].alias("side"), T.totals_spec(t)["line"].alias("line"))


_OU = r"(over|under)\s+(\d+(?:[.,]\d+)?)"


@query("outcome_map", "X16 J20", f"""WITH {TITLES}, o AS (SELECT p_partkey, p_name, t, CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Draw' ELSE p_name END AS outcome FROM title),
 m AS (SELECT *, lower(t) AS a, lower(outcome) AS s, CASE WHEN regexp_matches(lower(t), '{_OU}') THEN lower(t) WHEN regexp_matches(lower(outcome), '{_OU}') THEN lower(outcome) END AS src FROM o),
 d AS (SELECT *, regexp_extract(src, '{_OU}', 1) AS dir, replace(regexp_extract(src, '{_OU}', 2), ',', '.') AS line, {_holds('a', T.WINNER_WORDS)} AND s IN ('yes', 'no') AS win, s IN ('yes', 'no') AS bin FROM m),
 u AS (SELECT *, CASE WHEN bin AND s <> 'yes' THEN CASE WHEN dir = 'over' THEN 'under' ELSE 'over' END ELSE dir END AS turned FROM d)
 SELECT p_partkey, outcome, CASE WHEN src IS NOT NULL THEN 'BACK' WHEN win THEN CASE WHEN s = 'yes' THEN 'BACK' ELSE 'LAY' END WHEN NOT bin THEN 'BACK' END AS side,
 CASE WHEN src IS NOT NULL THEN upper(turned[1]) || turned[2:] || ' ' || line WHEN win THEN p_name WHEN NOT bin THEN CASE WHEN s IN ('draw', 'tie') THEN 'Draw' ELSE trim(outcome) END END AS selection,
 CASE WHEN src IS NOT NULL THEN 'OVER_UNDER' WHEN win OR NOT bin THEN 'MATCH_ODDS' END AS kind FROM u""")
def outcome_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("p_partkey") % 4 == 0, "Yes").when(F.col("p_partkey") % 4 == 1, "No").when(F.col("p_partkey") % 4 == 2, "Draw").otherwise(F.col("p_name"))
    rows = titles(spark, sf_dir).withColumn("outcome", outcome)
    return rows.select("p_partkey", "outcome", T.outcome_side(F.col("t"), F.col("outcome"), F.col("p_name")).alias("m")).select("p_partkey", "outcome", "m.*")


_ACCENT = f"translate(text, '{T.ACCENTED}', '{T.FOLDED}')"


@query("fold_accents", "X06", f"SELECT doc_id, md5({_ACCENT}) AS folded FROM documents")
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("folded"))


@query("reorder_names", "X07", """SELECT c_custkey, regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN string_split(c_mktsegment, 'I')[1] || ' ' || trim(c_name) ELSE 'J. ' || c_name END, '^[A-Z]\\.?\\s+', '') AS name FROM customer""")
def reorder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers are written "name, segment", odd ones "J. name"."""
    written = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(", "), F.get(F.split("c_mktsegment", "I"), F.lit(0)))).otherwise(F.concat(F.lit("J. "), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.reorder_name(written).alias("name"))


_PAIRS = "pair AS (SELECT a.p_partkey AS ka, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("ka"), F.col("p_name").alias("a"))
    b = part.select((F.col("p_partkey") - 1).alias("ka"), F.col("p_name").alias("b"))
    return a.join(b, "ka")


@query("pair_features", "X19 X20 X21", f"""WITH {_PAIRS}, w AS (SELECT ka, a, b, list_distinct({_words('lower(a)')}) AS x, list_distinct({_words('lower(b)')}) AS y FROM pair),
 i AS (SELECT *, list_intersect(x, y) AS i FROM w) SELECT ka, {q('CAST(len(i) AS DOUBLE) / greatest(len(x) + len(y) - len(i), 1)')} AS jaccard,
 {q('CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b), 1)')} AS length_ratio, CAST(len(i) AS DOUBLE) AS overlap,
 len(list_filter(i, lambda z: length(z) > 4)) >= 2 AS dependent, md5(lower(trim(a)) || '|' || lower(trim(b))) AS key FROM i""")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    f = T.pair_features(a, b)
    return _pairs(spark, sf_dir).select("ka", quantise(f["jaccard"]).alias("jaccard"), quantise(f["length_ratio"]).alias("length_ratio"), f["overlap"].alias("overlap"), T.keyword_dependency(a, b)["dependent"].alias("dependent"), T.stable_key(a, b).alias("key"))


def _sport_sql(x: str) -> str:
    return f"CASE WHEN {_holds(x, T.NO_SPORT)} THEN NULL " + " ".join(f"WHEN {_holds(x, p)} THEN '{n}'" for n, p in T.SPORTS) + " END"


@query("sport_and_region", "P29 S34 S35", f"""WITH {TITLES} SELECT p_partkey, {_sport_sql('lower(t)')} AS sport, CASE {' '.join(f"WHEN {_holds('lower(t)', p)} THEN '{n}'" for n, p in T.REGIONS)} ELSE '' END AS region FROM title""")
def sport_and_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", T.sport(F.col("t")).alias("sport"), T.region(F.col("t")).alias("region"))


def _clean_title_sql() -> str:
    t = "regexp_split_to_array(t, '[:\\-]')[1]"
    for pattern in T.TITLE_NOISE:
        t = f"regexp_replace({t}, '{pattern}', '', 'g')"
    return f"trim({t})"


_VERSUS = r"(.+?)\s+(?:vs|VS|v|V|@)\.?\s+(.+)"


@query("title_entities", "X18", f"""WITH {TITLES}, c AS (SELECT p_partkey, {_clean_title_sql()} AS clean FROM title),
 e AS (SELECT *, CASE WHEN regexp_matches(clean, '{_VERSUS}') THEN [trim(regexp_extract(clean, '{_VERSUS}', 1)), trim(regexp_extract(clean, '{_VERSUS}', 2))] WHEN clean <> '' AND len({_words('clean')}) <= 4 THEN [clean] ELSE [] END AS found FROM c)
 SELECT p_partkey, clean, array_to_string(list_filter(found, lambda n: length(n) >= 2 AND length(n) <= 40 AND NOT {_holds('lower(n)', T.TITLE_JUNK)}), '|') AS entities FROM e""")
def title_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", T.clean_event_title(F.col("t")).alias("clean"), F.array_join(T.title_entities(F.col("t")), "|").alias("entities"))


@query("garbage_aliases", "P21 K13", f"""WITH a AS (SELECT p_partkey, unnest([p_name, p_name[1], 'unknown', upper(p_name)]) AS alias FROM part), f AS (SELECT p_partkey, alias, translate(lower(alias), '{T.ACCENTED}', '{T.FOLDED}') AS folded FROM a
 WHERE NOT (length(alias) < 2 OR lower(alias) IN ('id', 'sport', 'metadata', 'unknown', 'null', 'undefined', 'n/a'))) SELECT p_partkey, folded, min(alias) AS alias FROM f GROUP BY 1, 2""")
def garbage_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders go, and of aliases with one folded form the first stays."""
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.explode(F.array(F.col("p_name"), F.substring("p_name", 1, 1), F.lit("unknown"), F.upper("p_name"))).alias("alias")).where(~T.is_garbage(F.col("alias")))
    return rows.groupBy("p_partkey", T.fold_accents(F.lower("alias")).alias("folded")).agg(F.min("alias").alias("alias"))


@query("json_props", "Y28 Y29 Y31", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are read as decimals, never by way of double."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k decimal(38,18)")["k"].cast("double").alias("k"))


@query("answer_json", "Y30 F05", """SELECT p_partkey, CAST(p_size AS DOUBLE) / 100 AS confidence FROM part WHERE p_partkey % 4 <> 3""")
def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in free answers: bare JSON, a fenced block, an object within a sentence, or none."""
    k = F.col("p_partkey")
    body = F.concat(F.lit('{"is_match": true, "confidence": '), (F.col("p_size") / 100).cast("string"), F.lit("}"))
    answer = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("I think "), body, F.lit(" fits"))).otherwise("no idea")
    rows = table(spark, sf_dir, "part").select("p_partkey", T.extract_json(answer).alias("json")).where("json is not null")
    return rows.select("p_partkey", F.get_json_object("json", "$.confidence").cast("double").alias("confidence"))
