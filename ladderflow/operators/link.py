"""Record linkage: blocked joins with a residual, dictionaries, token joins.

No join here compares all pairs: each has an equality on a bucket, a token or a name, and the condition follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderflow.functions import text as T
from ladderflow.operators import candidates
from ladderflow.operators.scratch import written

DAY = 86_400_000_000
#: Ids of one list of dealt_pairs().
MET_IDS = 1_024


def band_join(left: DataFrame, right: DataFrame, hours: int = 24) -> DataFrame:
    """Rows (id, ts, region) less than so many hours apart in one region; region 'global' on the right fits
    all. Right ids of one place and time are one list (numbered, so that none grows without bound), which goes to its own bucket and
    both neighbours; left rows go to their own, under their region and under 'global'. So each pair meets once, times are compared
    once for each list, and ids are laid out last. Tasks are stated, as few bytes make many rows here and would be put into few."""
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = hours * 3_600_000_000
    bucket = lambda c: F.floor(F.col(c) / width)
    numbered = F.row_number().over(Window.partitionBy("region", "b").orderBy("right_id"))
    b = right.select("region", micros.alias("b"), F.col("id").alias("right_id")).where("region IS NOT NULL AND b IS NOT NULL").withColumn("piece", F.floor(numbered / GROUPED_IDS))
    ids = F.transform(F.collect_list(F.struct("right_id")), lambda r: r["right_id"])  # a list of ids alone would drop nulls
    b = b.groupBy("region", "b", "piece").agg(ids.alias("right_ids")).select("region", "b", "right_ids", F.explode(F.sequence(bucket("b") - 1, bucket("b") + 1)).alias("bucket"))
    places = F.array_compact(F.array(F.when(F.col("region") != "global", F.col("region")), F.lit("global")))
    a = left.select(F.explode(places).alias("region"), micros.alias("a"), F.col("id").alias("left_id")).where("a IS NOT NULL").withColumn("bucket", bucket("a"))
    keys, gap = ["region", "bucket"], F.abs(F.col("a") - F.col("b"))
    met = a.repartition(parts, *keys).hint("merge").join(b.repartition(parts, *keys), keys).where(gap < width)
    return met.select("left_id", gap.alias("gap"), "right_ids").coalesce(parts).select("left_id", F.explode("right_ids").alias("right_id"), "gap")


def first_match(candidates: DataFrame, *order: str | Column) -> DataFrame:
    """Of each left row's candidates the first in the order, which must be total."""
    by = Window.partitionBy("left_id").orderBy(*order)
    return candidates.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def nearest_match(left: DataFrame, right: DataFrame, hours: int = 24) -> DataFrame:
    """The first of band_join() by gap and right_id of each left row that has one, without making the pairs. Right rows of
    one place and time are one, that of the least id; they go to their own bucket and both neighbours, left rows to their own, under
    their region and under the right side's 'global'. The nearest row is the last one before in a bucket's order, or the last
    one of the reverse order."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = hours * 3_600_000_000
    bucket = F.floor(F.col("t") / width)
    b = right.select("region", micros.alias("t"), "id").where("region IS NOT NULL AND t IS NOT NULL").groupBy("region", "t").agg(F.min("id").alias("right_id"))
    b = b.select("region", "t", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"), F.lit(None).alias("left_id"), "right_id", F.lit(0).alias("side"))
    places = F.array_compact(F.array(F.when(F.col("region") != "global", F.col("region")), F.lit("global")))
    a = left.select(F.explode(places).alias("region"), micros.alias("t"), F.col("id").alias("left_id")).where("t IS NOT NULL")
    rows = b.unionByName(a.select("region", "t", bucket.alias("bucket"), "left_id", F.lit(None).alias("right_id"), F.lit(1).alias("side")))
    by = Window.partitionBy("region", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    met = F.when(F.col("side") == 0, F.struct(F.col("t").alias("b"), "right_id"))
    near = rows.withColumn("_x", F.last(met, True).over(by.orderBy("t", "side"))).withColumn("_y", F.last(met, True).over(by.orderBy(F.desc("t"), "side"))).where("side = 1")
    gap = lambda c: F.when(F.abs(F.col("t") - F.col(f"{c}.b")) < width, F.struct(F.abs(F.col("t") - F.col(f"{c}.b")).alias("gap"), F.col(f"{c}.right_id").alias("right_id")))
    best = near.select("left_id", F.least(gap("_x"), gap("_y")).alias("m")).groupBy("left_id").agg(F.min("m").alias("m")).where("m IS NOT NULL")
    return best.select("left_id", "m.right_id", "m.gap")


def token_pairs(left: DataFrame, right: DataFrame, least: int = 2, least_length: int = 4) -> DataFrame:
    """Pairs of (id, tokens array) that share at least so many tokens, one of them long enough: see
    candidates.shared_tokens()."""
    return candidates.shared_tokens(left, right, least, least_length)


def jaccard_pairs(left: DataFrame, right: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of (id, tokens) that share at least so many tokens, with their Jaccard similarity."""
    size = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), F.size(F.array_distinct("tokens")).alias(f"{n}_size"))
    pairs = token_pairs(left, right, least, 0).join(size(left, "left"), "left_id").join(size(right, "right"), "right_id")
    return pairs.withColumn("jaccard", F.col("common") / (F.col("left_size") + F.col("right_size") - F.col("common")))


def jaccard_top(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """For each left row the k right rows of most shared tokens, ties by id, with their Jaccard similarity."""
    by = Window.partitionBy("left_id").orderBy(F.desc("common"), "right_id")
    return jaccard_pairs(left, right).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("left_id", "right_id", "common", "jaccard", "rank")


def resolve_exact(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical name by folded equality within a sport; null if unknown; of repeated aliases the last counts."""
    last = aliases.groupBy("sport", F.lower("alias").alias("alias_lc")).agg(F.max_by("canonical", "version").alias("canonical"))
    keyed = names.withColumn("alias_lc", F.lower(F.trim("name")))
    return keyed.join(last, ["sport", "alias_lc"], "left").drop("alias_lc")


def resolve_fuzzy(names: DataFrame, aliases: DataFrame, least: int = 85, salts: int = 16) -> DataFrame:
    """Exact, else the alias of the best token_sort_ratio among those that share a word, at least the threshold. The
    names of a word are dealt to several tasks."""
    from ladderflow.functions.fuzzy import sort_ratio_column

    exact = resolve_exact(names, aliases)
    open_ = exact.where("canonical is null").select("name", "sport").distinct()
    words = lambda df, c: df.withColumn("w", F.explode(F.array_distinct(T.words(F.lower(c)))))
    dealt = words(open_, "name").withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int"))
    copies = words(aliases, "alias").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = dealt.join(copies, ["sport", "w", "salt"]).select("sport", "name", "alias", "canonical").distinct()
    scored = pairs.withColumn("score", sort_ratio_column(F.col("name"), F.col("alias"))).where(F.col("score") >= least)
    best = scored.groupBy("sport", "name").agg(F.max_by("canonical", F.struct("score", "alias")).alias("fuzzy"))
    return exact.join(best, ["sport", "name"], "left").withColumn("canonical", F.coalesce("canonical", "fuzzy")).drop("fuzzy")


def best_fuzzy(titles: DataFrame, salts: int = 16) -> DataFrame:
    """For each title (id, kind, t) the other title of its kind of best token_sort_ratio among those that share a
    word, ties to the smaller id, with both ratios. Equal texts are scored once: a title's equals are the two least ids of
    its text. The left texts of a word are dealt to several tasks, and a pair is taken at its least word only."""
    from ladderflow.functions.fuzzy import set_ratio_column, sort_ratio_column

    least = F.row_number().over(Window.partitionBy("kind", "t").orderBy("id"))
    two = titles.select("id", "kind", "t").withColumn("_rn", least).where("_rn <= 2")
    texts = two.groupBy("kind", "t").agg(F.min("id").alias("first"), F.max("id").alias("second")).withColumn("ws", F.array_distinct(T.words(F.col("t")))).where("size(ws) > 0")
    left = texts.select("kind", F.col("t").alias("left"), F.col("ws").alias("lw"), F.explode("ws").alias("w"), F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int").alias("salt"))
    right = texts.select("kind", F.col("t").alias("right"), F.col("ws").alias("rw"), "first", F.explode("ws").alias("w")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = left.join(right, ["kind", "w", "salt"]).where((F.col("left") != F.col("right")) & (F.col("w") == F.array_min(F.array_intersect("lw", "rw"))))
    scored = pairs.select("kind", "left", "right", "first", sort_ratio_column(F.col("left"), F.col("right")).alias("score"))
    other = scored.groupBy("kind", F.col("left").alias("t")).agg(F.min_by(F.struct("right", "first", "score"), F.struct(-F.col("score"), F.col("first"))).alias("o"))
    known = texts.join(other, ["kind", "t"], "left").select("kind", "t", F.col("first").alias("_first"), F.col("second").alias("_second"), "o", sort_ratio_column(F.col("t"), F.col("t")).alias("_own"))
    rows = titles.select(F.col("id").alias("left_id"), "kind", "t").join(known, ["kind", "t"])
    same = F.when(F.col("left_id") != F.col("_first"), F.col("_first")).when(F.col("_second") != F.col("_first"), F.col("_second"))
    rows = rows.withColumn("s", F.when(same.isNotNull(), F.struct(F.col("t").alias("right"), same.alias("first"), F.col("_own").alias("score"))))
    ahead = F.col("o").isNull() | (F.col("s.score") > F.col("o.score")) | ((F.col("s.score") == F.col("o.score")) & (F.col("s.first") < F.col("o.first")))
    rows = rows.withColumn("best", F.when(F.col("s").isNotNull() & ahead, F.col("s")).otherwise(F.col("o"))).where("best is not null")
    return rows.select("left_id", F.col("best.first").alias("right_id"), F.col("best.score").alias("score"), set_ratio_column(F.col("t"), F.col("best.right")).alias("set_score"))


#: Ids of a list, and of a list that travels while rows are grouped: two lists of the first size make so few rows at once that memory is no matter.
LIST_IDS, GROUPED_IDS = 50, 1_000


def listed(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and name + "s": the ids of rows that are equal in by, as short lists; a key's rows are grouped in pieces, by a hash."""
    pieces = max(1, -(-df.count() // (GROUPED_IDS * GROUPED_IDS)))
    grouped = df.groupBy(*by, F.pmod(F.xxhash64(name), F.lit(pieces)).alias("piece")).agg(F.collect_list(name).alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(LIST_IDS))
    return grouped.select(*by, F.explode(F.transform(starts, lambda i: F.slice("ids", i, F.lit(LIST_IDS)))).alias(f"{name}s"))


def meet(left: DataFrame, right: DataFrame, on: list[str], pairs: DataFrame, tasks: int = 4) -> DataFrame:
    """left joined with right, where a row (left_ids, right_ids) makes many pairs: by pairs (on, pairs) of each key, a key that makes more
    than its part of all pairs is dealt to shares, left rows by their hash, right ones to each. Tasks are stated, as few bytes make many
    rows here and would be put into one."""
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = max(1, (pairs.agg(F.sum("pairs")).first()[0] or 0) // (tasks * parts))
    hot = F.broadcast(pairs.where(F.col("pairs") > each).select(*on, F.ceil(F.col("pairs") / each).alias("shares")))  # at most tasks * parts keys
    shares = F.coalesce("shares", F.lit(1))
    a = left.join(hot, on, "left").withColumn("share", F.pmod(F.xxhash64("left_ids"), shares)).drop("shares")
    b = right.join(hot, on, "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares")
    keys = [*on, "share"]
    return a.repartition(parts, *keys).hint("merge").join(b.repartition(parts, *keys), keys).drop("share").coalesce(parts)  # a step of its own: the join would hold all rows of a left list at once


def unlisted(met: DataFrame, *columns: str) -> DataFrame:
    """left_id, right_id and columns of rows (left_ids, right_ids, ...): all pairs of their ids."""
    return met.select(F.explode("left_ids").alias("left_id"), "right_ids", *columns).select("left_id", F.explode("right_ids").alias("right_id"), *columns)


def fuzzy_pairs(left: DataFrame, right: DataFrame, keep: float = 60, good: float = 75, share_word: bool = True) -> DataFrame:
    """All pairs (id, t) whose token-sort and token-set ratios are above the threshold on average; good ones are marked.
    With share_word only those that share a word. Equal pairs of texts are compared once.

    Without a shared word both ratios compare the sorted words, with and without repeats; a mean above the threshold needs one
    of them above it, so candidates are the pairs whose counted characters allow that (candidates.ratio_pairs)."""
    from ladderflow.functions.fuzzy import set_ratio_column, sort_ratio_column

    if share_word:
        tokens = lambda df: df.select(F.col("t").alias("id"), T.words(F.col("t")).alias("tokens")).distinct()
        met = token_pairs(tokens(left), tokens(right), 1, 0).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    else:
        met = _near_names(left, right, math.floor(keep) + 0.5, ["once", "whole"])
    mean = (sort_ratio_column(F.col("a"), F.col("b")) + set_ratio_column(F.col("a"), F.col("b"))) / 2
    scored = written(met.withColumn("score", mean).where(F.col("score") > keep), "scored")
    # texts that fit are few, rows that bear them many: ids travel as lists, and each text's pairs are dealt to tasks by their number
    a, b = left.select(F.col("t").alias("a"), F.col("id").alias("left_id")), right.select(F.col("t").alias("b"), F.col("id").alias("right_id"))
    bearers = lambda df, k, n: df.groupBy(k).agg(F.count("*").alias(n))
    pairs = scored.join(bearers(b, "b", "m"), "b").groupBy("a").agg(F.sum("m").alias("m")).join(bearers(a, "a", "n"), "a").select("a", (F.col("n") * F.col("m")).alias("pairs"))
    fits = scored.join(listed(b, ["b"], "right_id"), "b").select("a", "score", (F.col("score") > good).alias("good"), "right_ids")
    return unlisted(meet(listed(a, ["a"], "left_id"), fits, ["a"], written(pairs, "pairs")), "score", "good")


def _near_names(left: DataFrame, right: DataFrame, least: float, kinds: list[str]) -> DataFrame:
    """a, b: pairs of distinct texts (t) that share a word of letters and digits, or of which a form ("once" or "whole": the sorted
    words, without or with repeats) can reach the ratio. Forms that differ for no text are taken once."""
    sides = [written(df.select("t").distinct().select("t", candidates.forms(F.col("t")).alias("f")).select("t", "f.*"), "forms") for df in (left, right)]
    if len(kinds) > 1 and all(df.where("once <> whole").isEmpty() for df in sides):
        kinds = kinds[:1]
    words = [df.select(F.col("t").alias("id"), F.col("words").alias("tokens")) for df in sides]
    met = token_pairs(*words, 1, 0).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    for kind in kinds:
        units = [df.select(F.col(kind).alias("id")).distinct().select("id", candidates.counted_letters(F.col("id")).alias("units")) for df in sides]
        named = [df.select(F.col("t").alias(n), F.col(kind).alias(f"{side}_id")) for df, n, side in zip(sides, "ab", ("left", "right"), strict=True)]
        met = met.union(candidates.ratio_pairs(*units, least).join(named[0], "left_id").join(named[1], "right_id").select("a", "b"))
    return met.distinct()


def hybrid_top(left: DataFrame, right: DataFrame, k: int = 10, least_ratio: int = 70, least_overlap: float = 0.3) -> DataFrame:
    """Of each left row (id, t) the k right rows that pass one of three filters (token-set ratio, share of words, a common
    word), best first by the larger of ratio / 100 and share; ties go to the smaller id.

    Rows without a common word pass by the ratio alone; those meet by their counted characters, a bound that depends on both
    lengths and loses no pair, however short the texts are (candidates.ratio_pairs).
    """
    from ladderflow.functions.fuzzy import set_ratio_column

    keyed = lambda df: df.select(F.col("t").alias("id"), T.words(F.lower("t")).alias("tokens")).distinct()
    met = token_pairs(keyed(left), keyed(right), 1, 0).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    met = met.union(_near_names(left, right, least_ratio, ["once"])).distinct()
    x, y = F.array_distinct(T.words(F.lower("a"))), F.array_distinct(T.words(F.lower("b")))
    common = F.size(F.array_intersect(x, y))
    scored = met.withColumn("ratio", set_ratio_column(F.col("a"), F.col("b"))).withColumn("common", common).withColumn("share", common / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1)))
    scored = scored.where((F.col("ratio") >= least_ratio) | (F.col("share") >= least_overlap) | (F.col("common") > 0)).withColumn("score", F.greatest(F.col("ratio") / 100, F.col("share")))
    texts = right.groupBy(F.col("t").alias("b")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k).alias("ids"))  # of equal texts the k least ids can be among the best
    best = scored.join(texts, "b").select("a", "score", F.explode("ids").alias("right_id"))
    by = Window.partitionBy("a").orderBy(F.desc("score"), "right_id")
    best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return left.select(F.col("id").alias("left_id"), F.col("t").alias("a")).join(best, "a").select("left_id", "right_id", "score", "rank")


def mentioned(texts: DataFrame, aliases: DataFrame, least_length: int = 3, most_broadcast: int = 100_000) -> DataFrame:
    """The canonical names whose aliases a text holds; the first word of an alias must be a word of the text, which
    makes the search an equality join. Aliases are counted before they are broadcast; texts never are."""
    a = aliases.where(F.length("alias") >= least_length).select(F.lower("alias").alias("alias"), "canonical").withColumn("w", F.get(T.words(F.col("alias")), F.lit(0)))
    a = written(a, "aliases")
    a = F.broadcast(a) if a.count() <= most_broadcast else a.hint("merge")
    t = texts.select("id", F.lower("text").alias("text")).withColumn("w", F.explode(F.array_distinct(T.words(F.col("text")))))
    return t.join(a, "w").where(F.contains("text", "alias")).groupBy("id").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"))


def once(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """rows with columns that depend on the keys alone and are dear: made once for each distinct value of the keys, dealt to all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    made = rows.select(*keys).distinct().repartition(4 * cores, *keys).select(*[F.col(k).alias(f"_{k}") for k in keys], *[c.alias(n) for n, c in columns.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.hint("merge").join(made, same).drop(*[f"_{k}" for k in keys])


def sides(x: Column) -> Column:
    """Parts of a title around vs, @ or a dash, of more than two letters."""
    return F.filter(F.transform(F.split(F.lower(x), r" vs\.? | v\.? | @ | - "), lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def _normal_side(s: Column, sport: str) -> Column:
    if sport == "soccer":
        for old, new in (("utd", "united"), ("man city", "manchester city"), ("man utd", "manchester united"), ("psg", "paris saint germain")):
            s = F.replace(s, F.lit(old), F.lit(new))
    return s


def overlap(title: Column, other: Column, sport: str) -> Column:
    """Every side of the first title fits a side of the second: by a shared word that is not generic, or by a generic
    one if one name holds the other; words that tell teams apart (state, tech, st, ...) must stand on both or neither."""
    arr = lambda xs: F.array(*map(F.lit, xs))
    tokens = lambda s: F.array_except(F.regexp_extract_all(s, F.lit(r"\w+"), F.lit(0)), arr(T.OVERLAP_STOP))
    bare = lambda s: F.trim(F.regexp_replace(s, "fc|bc", ""))

    def fits(p: Column, b: Column) -> Column:
        x, y = tokens(p), tokens(b)
        shared = F.array_intersect(x, y)
        generic = F.size(F.array_except(shared, arr(T.GENERIC))) == 0
        lone = (F.size(shared) == 1) & generic
        differs = F.lit(False)
        for w in [*T.DANGEROUS, "st"]:
            differs = differs | (F.array_contains(x, w) != F.array_contains(y, w))
        ok = ~differs
        if sport == "soccer":
            ok = ok & ~generic
        if sport in T.NEGATIVE:
            bad = arr(T.NEGATIVE[sport])
            a, c = F.array_intersect(x, bad), F.array_intersect(y, bad)
            ok = ok & (F.size(F.array_except(a, c)) == 0) & (F.size(F.array_except(c, a)) == 0)
        contained = F.contains(bare(b), bare(p)) | F.contains(bare(p), bare(b))
        return (F.size(shared) > 0) & F.when(lone, contained).otherwise(ok)

    norm = lambda s: _normal_side(s, sport)
    ps, bs = F.transform(sides(title), norm), F.transform(sides(other), norm)
    found = F.transform(ps, lambda p: F.exists(bs, lambda b: fits(p, b)))
    every, some = F.forall(found, lambda x: x), F.exists(found, lambda x: x)
    return F.when((F.size(ps) == 0) | (F.size(bs) == 0), True).when(F.size(ps) >= 2, every).otherwise(some)


def guardrail(title: Column, other: Column, title_entities: Column, other_entities: Column) -> Column:
    """Struct (ok, reason): a shared canonical name; else, if both titles have two sides, every side must share a
    clean word with one of the other; else a shared clean word."""
    shared = F.size(F.array_intersect(title_entities, other_entities)) > 0
    parts = lambda x: F.filter(F.transform(F.split(F.lower(x), r" vs\.? | v\.? | @ | - "), lambda s: F.trim(s)), lambda s: s != "")
    ps, bs = parts(title), parts(other)
    both = (F.size(ps) >= 2) & (F.size(bs) >= 2)
    each = F.forall(ps, lambda p: F.exists(bs, lambda b: F.arrays_overlap(T.clean_tokens(p), T.clean_tokens(b))))
    words = F.size(F.array_intersect(T.clean_tokens(title), T.clean_tokens(other))) >= 1
    reason = F.when(shared, "shared_canonical").when(both & ~each, "no_double_side").when(words, "shared_tokens").otherwise("no_match")
    return F.struct(reason.isin("shared_canonical", "shared_tokens").alias("ok"), reason.alias("reason"))


#: Fixed values of the matcher: words that names share, names with two spellings, rivals, legal suffixes.
MATCH_STOP = "fc cf sc afc cd esports club de the v vs u21 u23 fk sk al town".split()
MATCH_TEAM_STOP = "utd united city real athletic".split()
SYNONYMS = {"man utd": "manchester united", "man city": "manchester city", "barca": "barcelona", "g2": "g2 esports", "psg": "paris saint germain"}
RIVALS = (("city", "united"), ("real", "atletico"), ("paris", "psg"))
PARIS_SIGNS = ("psg", "saint", "germain", "st germain", "saint germain")
LEGAL_SUFFIXES = "fc cf cd bc sc united city club".split()
LOOSE_WORDS = "fc club team real".split()


def static_match(a: Column, b: Column, sport: str = "", canonical_a: Column | None = None, canonical_b: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """The first rule of the cascade that joins two names, null for none. canonical_*: names from a dictionary;
    overrides: alias -> canonical of the sport, a small literal table."""
    from ladderflow.functions.fuzzy import set_ratio_column

    overrides = overrides or {}
    literal = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    low = lambda x: F.trim(F.lower(x))
    bare = lambda x: F.regexp_replace(T.fold_accents(low(x)), r"[^a-z0-9]", " ")
    stop = MATCH_STOP + ([] if sport == "soccer" else MATCH_TEAM_STOP)

    def tokens(x: Column) -> Column:
        own = F.regexp_replace(T.fold_accents(F.regexp_replace(F.lower(T.reorder_name(x)), rf"\b({'|'.join(stop)})\b", "")), r"[^a-z0-9]", " ")
        more = [F.when(bare(x).contains(k), literal(v.split())).otherwise(literal([])) for k, v in SYNONYMS.items()]
        more += [F.when(F.lower(x).contains(k), literal(v.lower().split())).otherwise(literal([])) for k, v in overrides.items()]
        return F.array_distinct(F.concat(T.words(F.trim(own)), *more))

    def person(x: Column) -> tuple[Column, Column]:
        """First names and surname."""
        n = F.trim(F.regexp_replace(F.lower(x), r"\.", " "))
        parts = F.split(n, ",")
        ws = T.words(n)
        swapped = F.size(parts) == 2
        first = F.when(swapped, F.trim(F.get(parts, F.lit(1)))).otherwise(F.array_join(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), " "))
        last = F.when(swapped, F.trim(F.get(parts, F.lit(0)))).otherwise(F.try_element_at(ws, F.lit(-1)))
        return first, F.coalesce(last, F.lit(""))

    x, y, bx, by = tokens(a), tokens(b), bare(a), bare(b)
    has = lambda t, w: F.array_contains(t, w)
    rivals = F.lit(False)
    for p, q in RIVALS:
        rivals = rivals | (has(x, p) & has(y, q)) | (has(x, q) & has(y, p))
    sign = lambda t, n: F.arrays_overlap(t, literal(PARIS_SIGNS)) | T.holds(n, PARIS_SIGNS)
    rivals = rivals | (has(x, "paris") & has(y, "paris") & (sign(x, bx) != sign(y, by)))
    shared = F.array_intersect(x, y)
    n = F.size(shared)
    subset = (n > 0) & ((n == F.size(x)) | (n == F.size(y))) & (F.size(F.array_except(shared, literal(LOOSE_WORDS))) > 0)
    inside = (n > 0) & (by.contains(bx) | bx.contains(by))
    (fa, la), (fb, lb) = person(a), person(b)
    surname = (la != "") & (lb != "") & (la.contains(lb) | lb.contains(la))
    first = (fa == "") | (fb == "") | (F.substring(fa, 1, 1) == F.substring(fb, 1, 1))
    strip = lambda t: F.trim(F.regexp_replace(low(t), rf" ({'|'.join(LEGAL_SUFFIXES)})$", ""))
    known = F.lit(False)
    if canonical_a is not None and canonical_b is not None:
        known = F.coalesce(canonical_a == canonical_b, F.lit(False)) | F.coalesce(F.lower(canonical_a) == F.lower(b), F.lit(False)) | F.coalesce(F.lower(canonical_b) == F.lower(a), F.lit(False))
    listed = bx.isin(*overrides) | by.isin(*overrides) if overrides else F.lit(False)
    return (
        F.when(known, "canonical").when(low(a) == low(b), "equal").when(listed, "alias").when(rivals, F.lit(None).cast("string")).when(set_ratio_column(a, b) >= 85, "ratio85").when(subset, "subset")
        .when(inside, "substring").when(surname & first, "surname").when((strip(a) == strip(b)) & (F.length(strip(a)) > 3), "suffix").when(set_ratio_column(bx, by) >= 90, "ratio90")
    )


def name_cascade(left: DataFrame, right: DataFrame, least_common: int = 2, least_jaccard: float = 0.6) -> DataFrame:
    """Left and right (id, name): by equal name, else by one side of a title that equals a name, else by shared
    words of Jaccard similarity above the least (most shared words first). The first stage that hits counts; ties go to the
    smaller right id. stage: name, side or words."""
    plain = lambda c: F.replace(F.replace(F.lower(c), F.lit(" vs "), F.lit(" ")), F.lit(" v "), F.lit(" "))
    names = right.groupBy(plain("name").alias("key")).agg(F.min("id").alias("right_id"))
    own = left.select(F.col("id").alias("left_id"), plain("name").alias("key"), T.split_versus(F.col("name")).alias("sides"))
    by_name = own.join(names, "key").select("left_id", "right_id", F.lit("name").alias("stage"))
    rest = own.join(by_name, "left_id", "left_anti")
    side = rest.select("left_id", F.posexplode("sides").alias("pos", "side")).select("left_id", "pos", plain("side").alias("key"))
    by_side = side.join(names, "key").groupBy("left_id").agg(F.min_by("right_id", "pos").alias("right_id")).withColumn("stage", F.lit("side"))
    rest = rest.join(by_side, "left_id", "left_anti")
    tokens = lambda df, i, k: df.select(F.col(i).alias("id"), F.array_distinct(T.words(F.col(k))).alias("tokens"))
    words = candidates.similar_sets(tokens(rest, "left_id", "key"), tokens(names, "right_id", "key"), least_jaccard)
    best = words.where(F.col("common") >= least_common).groupBy("left_id").agg(F.min_by("right_id", F.struct(-F.col("common"), F.col("right_id"))).alias("right_id"))
    return by_name.unionByName(by_side).unionByName(best.withColumn("stage", F.lit("words")))


def prop_match(props: DataFrame, titles: DataFrame, least: int = 85) -> DataFrame:
    """Player props (prop_id, stat, line, player) and titles (title_id, stat, line, title) of one statistic and line
    whose names fit: partial token-set ratio of at least so much. Names of a statistic and line meet once, however many rows bear
    them; rows are joined to the pairs that fit."""
    from ladderflow.functions.fuzzy import partial_set_ratio_column

    by = ["stat", "line"]
    parts = int(props.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes make many rows here and would be put into one task
    names, texts = props.select(*by, "player").distinct(), titles.select(*by, "title").distinct()
    met = names.repartition(parts, *by).hint("merge").join(texts.repartition(parts, *by), by)
    asked = met.select("player", "title").distinct()
    scored = written(asked.withColumn("score", partial_set_ratio_column(F.col("player"), F.col("title"))).where(F.col("score") >= least), "scored")
    # ids of a title travel as lists, in pieces, so that nothing is shuffled once for each pair of rows
    pieces = titles.groupBy(*by, "title", F.pmod(F.xxhash64("title_id"), F.lit(8)).alias("piece")).agg(F.collect_list("title_id").alias("title_ids")).drop("piece")
    fits = met.join(scored, ["player", "title"]).join(pieces.hint("merge"), [*by, "title"]).select(*by, "player", "score", "title_ids")
    return props.repartition(parts, *by, "player").hint("merge").join(fits.repartition(parts, *by, "player"), [*by, "player"]).select("prop_id", F.explode("title_ids").alias("title_id"), "score")


def dealt_pairs(left: DataFrame, right: DataFrame, by: list[str], left_id: str, right_id: str, shares: int = 8) -> DataFrame:
    """left_id, right_id of all pairs of rows that are equal in by, where few keys make many pairs. Ids of a key travel as lists of at most
    MET_IDS; left ones are dealt to shares, each of which meets all right ones, list by list, so no list grows with the table. Tasks are
    stated, as few bytes make many rows here and would be put into one task. The rows of two lists come together and repeat the right
    one for each left id, so files of them are small however many ids a key has."""
    parts = max(left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def lists(df: DataFrame, x: str, name: str) -> DataFrame:
        dealt = df.select(*by, F.col(x).alias("x"), F.pmod(F.xxhash64(x), F.lit(shares)).cast("int").alias("share"))
        numbered = F.row_number().over(Window.partitionBy(*by, "share").orderBy("x"))
        ids = F.transform(F.sort_array(F.collect_list(F.struct("x"))), lambda r: r["x"])  # a list of ids alone would drop nulls
        return dealt.withColumn("piece", F.floor((numbered - 1) / MET_IDS)).groupBy(*by, "share", "piece").agg(ids.alias(name)).drop("piece")

    pieces = lists(right, right_id, "right_ids").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    on = [*by, "share"]
    met = lists(left, left_id, "left_ids").repartition(parts, *on).hint("merge").join(pieces.repartition(parts, *on), on)
    return met.select(F.explode("left_ids").alias(left_id), "right_ids").select(left_id, F.explode("right_ids").alias(right_id))


def triangle(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """Links A-B and B-C with one B."""
    return ab.join(bc, "b").select("a", "b", "c")


def price_chain(markets: DataFrame, events: DataFrame, prices: DataFrame) -> DataFrame:
    """Market, its event and its price."""
    return markets.join(events, "event_id").join(prices, "market_id")
