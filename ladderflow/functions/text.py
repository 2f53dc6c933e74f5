"""Text rules of record linkage as column expressions.

Stop lists differ by operator on purpose and are not merged. All functions read null as null unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists, each for its own operator.
LEGACY_STOP = "will beat win winner vs against soccer match uefa champions league fc cf".split()
CLEAN_STOP = (
    "will win on the vs v game match bet odds score team club united city real soccer football basket points goals over under total handicap and or for to be is "
    "at by of a an this 2024 2025 2026 2027 2028 first second third quarter half period championship league receiving yards assists rebounds player props"
).split()
OVERLAP_STOP = "the and for will win match odds ends draw both teams score end".split()
GENERIC = "city united fc bc real st st. san santa state tech university univ college".split()
DANGEROUS = "state tech university univ college a&m southern northern eastern western".split()
NEGATIVE = {"soccer": "city united real atletico".split(), "basketball": "state st".split(), "baseball": "sox state".split(), "tennis": "jr sr".split()}
WINNER_STOP = "the win will match odds fc bc st san club de vs and".split()
LEARNER_STOP = "will win on the vs v fc sc game match 2024 2025 2026 over under spread points goals".split()
SEARCH_STOP = "the fc cf bc sc united city real club de vs v and".split()
SUFFIXES = r"fc cf sc ac cs cd sv s\.a\.d\. sad inc corp limited ltd esports gaming team club united city real atletico sporting".split()
NOISE = ("valorant:", "cs:go:", "counter-strike:", "lol:", "dota 2:", "nba:", "nfl:", "nhl:", "mlb:", "epl:", "bo3", "bo5", r"map \d", r"game \d", r"round \d")
WINNER_WORDS = ("win", "winner", "to beat", "victory", "champion")
TOTAL_WORDS, SPREAD_WORDS = ("over", "under", "o/u", "total"), ("spread", "handicap", "line")
BOTH_SCORE_WORDS = ("btts", "both teams to score", "ambos marcan")
#: Sports by the first words that a title holds, and the words of titles that are no sport.
NO_SPORT = "election politics senate governor president crypto bitcoin eth price movie oscars".split()
SPORTS = (
    ("soccer", "soccer premier-league la-liga serie-a bundesliga ligue-1 mls".split()), ("basketball", "nba basketball euroleague wnba".split()), ("tennis", "tennis atp wta".split()),
    ("ice_hockey", "nhl hockey".split()), ("american_football", "nfl football ncaa-football".split()), ("baseball", "baseball mlb".split()), ("soccer", "vs defeats beats".split()),
)
REGIONS = (
    ("england", ("premier league", "england", "efl", "fa cup")), ("spain", ("la liga", "laliga", "spain", "copa del rey")), ("italy", ("serie a", "italy", "coppa italia")),
    ("germany", ("bundesliga", "germany", "dfb")), ("france", ("ligue 1", "ligue1", "france")), ("usa", ("nba", "wnba", "mlb", "nfl", "nhl", "usa")),
)
#: Accented letters and what they fold to.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçšžčćđðłøÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇŠŽ"
FOLDED = "aaaaaaaeeeeeiiiiioooooouuuuuyyncszccddloAAAAAAEEEEIIIIOOOOOUUUUYNCSZ"


def words(x: Column) -> Column:
    """Parts between blanks, without empty ones."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def without(ws: Column, stop: list[str]) -> Column:
    """Words that are not in the list."""
    return F.filter(ws, lambda w: ~w.isin(*stop))


def holds(x: Column, parts) -> Column:
    """Whether a text holds any of the parts."""
    return reduce(lambda a, b: a | b, (x.contains(p) for p in parts))


def normalize_title(x: Column) -> Column:
    """Lower case, letters and blanks only, without stop words."""
    return F.array_join(without(words(F.regexp_replace(F.lower(x), r"[^a-z\s]", "")), LEGACY_STOP), " ")


def collapse(x: Column) -> Column:
    """Lower case, letters, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", ""), r"\s+", " "))


def clean_name(x: Column) -> Column:
    """An entity's name without noise words, without suffixes (each taken off once, in the order of the list) and
    without punctuation."""
    low = F.regexp_replace(F.trim(F.lower(x)), "|".join(NOISE), "")
    for suffix in SUFFIXES:
        low = F.regexp_replace(low, rf"\s+{suffix}$", "")
    return F.trim(F.regexp_replace(low, r"[^a-zA-Z0-9\s]", ""))


def clean_tokens(x: Column) -> Column:
    """Distinct words of the clean name, of at least two letters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(without(words(clean_name(x)), CLEAN_STOP), lambda w: F.length(w) >= 2)))


def search_tokens(x: Column) -> Column:
    """Words of more than two letters for searching, sorted."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"\w+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(without(found, SEARCH_STOP), lambda w: F.length(w) > 2)))


def learner_tokens(x: Column) -> Column:
    """Words of at least three letters for learning, sorted."""
    return F.array_sort(F.array_distinct(F.filter(without(words(collapse(x)), LEARNER_STOP), lambda w: F.length(w) >= 3)))


def split_versus(x: Column) -> Column:
    """[whole, home, away] if exactly two sides of more than two letters stand around vs, else [whole]."""
    sides = F.transform(F.split(x, r" vs\.? | v | @ "), lambda s: F.trim(s))
    two = (F.size(sides) == 2) & F.forall(sides, lambda s: F.length(s) > 2)
    return F.when(two, F.concat(F.array(x), sides)).otherwise(F.array(x))


def fold_accents(x: Column) -> Column:
    """Letters of Latin-1 and Latin Extended-A without their accents."""
    return F.translate(x, ACCENTED, FOLDED)


def reorder_name(x: Column) -> Column:
    """X07: "Last, First" becomes "First Last"; a capital initial before the name goes."""
    parts = F.split(F.trim(x), ",")
    turned = F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0))))).otherwise(F.trim(x))
    return F.regexp_replace(turned, r"^[A-Z]\.?\s+", "")


def person_aliases(x: Column) -> Column:
    """X11: the text itself and, for names of two words, "f. last", "last, f.", "f last" and "last"; sorted."""
    ws = words(F.lower(F.trim(x)))
    first, last = F.get(ws, F.lit(0)), F.get(ws, F.lit(1))
    initial = F.substring(first, 1, 1)
    forms = F.array(F.concat(initial, F.lit(". "), last), F.concat(last, F.lit(", "), initial, F.lit(".")), F.concat(initial, F.lit(" "), last), last)
    return F.array_sort(F.array_distinct(F.when((F.size(ws) == 2) & (F.length(last) > 1), F.concat(F.array(x), forms)).otherwise(F.array(x))))


def line_value(x: Column) -> Column:
    """The last number in a text."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(r"[+-]?\d+\.?\d*"), F.lit(0)), F.lit(-1)).cast("double")


def structure(x: Column) -> Column:
    """Struct of scope, kind, subtype and entity of a market's title. As in the rule set, "td" counts anywhere in a
    word."""
    low = F.lower(x)
    scope = F.when(holds(low, ("1h", "1st half", "first half")), "h1").when(holds(low, ("2h", "2nd half")), "h2").when(holds(low, ("q1", "1st quarter")), "q1").when(low.contains("set 1"), "set1").otherwise("full")
    touchdown = holds(low, ("touchdown", "td"))
    prop = touchdown | holds(low, ("rebound", "assist", "point"))
    kind = F.when(prop, "player_prop").when(holds(low, ("spread", "handicap")), "spread").when(holds(low, ("total", "over", "under")), "total").otherwise("moneyline")
    sub = (
        F.when(touchdown, F.when(low.contains("first"), "first_td").otherwise("anytime_td")).when(low.contains("rebound"), "rebounds")
        .when(low.contains("assist"), "assists").when(low.contains("point"), "points").otherwise("main")
    )
    return F.struct(scope.alias("scope"), kind.alias("kind"), sub.alias("subtype"), F.when(prop, "player").otherwise("match").alias("entity"))


def market_type(x: Column) -> Column:
    """DRAW before TOTALS before MATCH_WINNER, else UNKNOWN."""
    low = F.lower(x)
    return (
        F.when(low.rlike(r"\b(draw|tie|empate)\b"), "DRAW").when(low.rlike(r"(over|under|o/u)\s*(\d+(?:\.\d+)?)"), "TOTALS")
        .when(holds(low, ("win", "victory", "to beat", "champion")), "MATCH_WINNER").otherwise("UNKNOWN")
    )


def totals_spec(x: Column) -> Column:
    """Struct of side and line of the first total in a text, null without one; O/U counts as UNDER."""
    pattern = r"(?i)(over|under|o/u)\s*(\d+(?:\.\d+)?)"
    side, line = F.upper(F.regexp_extract(x, pattern, 1)), F.nullif(F.regexp_extract(x, pattern, 2), F.lit("")).cast("double")
    return F.struct(F.when(line.isNotNull(), F.when(side == "OVER", "OVER").otherwise("UNDER")).alias("side"), line.alias("line"))


def base_type(x: Column) -> Column:
    """The kind of market that a title tells."""
    low = F.lower(x)
    return F.when(holds(low, TOTAL_WORDS), "TOTALS").when(holds(low, SPREAD_WORDS), "SPREAD").when(holds(low, BOTH_SCORE_WORDS), "BTTS").when(holds(low, ("draw", "empate")), "DRAW").otherwise("WINNER")


def fingerprint(x: Column, kind: Column) -> Column:
    """type[:line]:period; an empty type is told from the title; only totals and spreads have a line."""
    low = F.lower(x)
    told = F.coalesce(F.nullif(kind, F.lit("")), base_type(x))
    period = (
        F.when(holds(low, ("1h", "1st half", "primer tiempo", "first half")), "first_half").when(holds(low, ("2h", "2nd half", "second half", "segundo tiempo")), "second_half")
        .when(holds(low, ("quarter", "q1", "q2")), "quarter").otherwise("full_time")
    )
    line = F.when(told.isin("TOTALS", "SPREAD"), line_value(low).cast("string"))
    return F.concat_ws(":", told, line, period)


def outcome_side(question: Column, outcome: Column, entity: Column) -> Column:
    """Struct of side, selection and kind of an outcome of a question; nulls where the intent is unknown."""
    asked, said = F.lower(question), F.lower(outcome)
    pattern = r"(over|under)\s+(\d+(?:[.,]\d+)?)"
    source = F.when(asked.rlike(pattern), asked).when(said.rlike(pattern), said)
    direction, line = F.regexp_extract(source, pattern, 1), F.translate(F.regexp_extract(source, pattern, 2), ",", ".")
    binary = F.trim(said).isin("yes", "no")
    turned = F.when(binary & (said != "yes"), F.when(direction == "over", "under").otherwise("over")).otherwise(direction)
    winner = holds(asked, WINNER_WORDS) & said.isin("yes", "no")
    named = F.when(said.isin("draw", "tie"), "Draw").otherwise(F.trim(outcome))
    side = F.when(source.isNotNull(), "BACK").when(winner, F.when(said == "yes", "BACK").otherwise("LAY")).when(~binary, "BACK")
    selection = F.when(source.isNotNull(), F.concat_ws(" ", F.initcap(turned), line)).when(winner, entity).when(~binary, named)
    kind = F.when(source.isNotNull(), "OVER_UNDER").when(winner | ~binary, "MATCH_ODDS")
    return F.struct(side.alias("side"), selection.alias("selection"), kind.alias("kind"))


def keyword_dependency(a: Column, b: Column) -> Column:
    """Struct (true, 0.6) if two words of more than four letters are shared, else (false, 0.1)."""
    shared = F.filter(F.array_intersect(words(F.lower(a)), words(F.lower(b))), lambda w: F.length(w) > 4)
    yes = F.size(shared) >= 2
    return F.struct(yes.alias("dependent"), F.when(yes, 0.6).otherwise(0.1).alias("confidence"))


def stable_key(*parts: Column) -> Column:
    """md5 of the trimmed lower-cased parts."""
    return F.md5(F.concat_ws("|", *(F.lower(F.trim(p)) for p in parts)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays over their union; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def pair_features(a: Column, b: Column) -> Column:
    """Struct of Jaccard similarity, length ratio and number of shared tokens of two names."""
    tokens = lambda x: F.array_distinct(words(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", " ")))
    x, y = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(x, y))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.struct((shared / F.greatest(F.size(F.array_union(x, y)), F.lit(1))).alias("jaccard"), ratio.alias("length_ratio"), shared.cast("double").alias("overlap"))


def is_garbage(alias: Column) -> Column:
    """Aliases of less than two letters and placeholder words."""
    return (F.length(alias) < 2) | F.lower(alias).isin("id", "sport", "metadata", "unknown", "null", "undefined", "n/a")


#: What is taken off a title, in this order, and words that no name holds.
TITLE_NOISE = (
    r"(?i)^(Will|Who|How many|Total|Over/Under|Spread|Market)\s+",
    r"(?i)\s+(win\??|defeat\??|beats\??|win on|win the|win by|win game\s?\d|win match\s?\d|sells any|price|at any point|O/U\s?[\d\.]+|\?)$",
    r"(?i)\b(Over/Under|Handicap|Total Goals|Total Games|Total Sets|Asian Handicap|Winner|Markets|Correct Score|BTTS)\b.*",
    r"\b(202[0-9]|2[0-9]-[0-9]{2})\b",
    r"(?i)\b(Final|Semifinal|Round \d|Wimbledon|US Open|French Open|Australian Open|NBA|NFL|MLB|UFC|EPL|La Liga)\b",
)
TITLE_JUNK = ("o/u", "3.5", "2.5", "total", "handicap", "score", "games")


def clean_event_title(x: Column) -> Column:
    """The part before a colon or dash, without prefixes, suffixes, betting terms, years and rounds."""
    t = F.get(F.split(x, r"[:\-]"), F.lit(0))
    for pattern in TITLE_NOISE:
        t = F.regexp_replace(t, pattern, "")
    return F.trim(t)


def title_entities(x: Column) -> Column:
    """The names around vs, or a short title itself; names of 2 to 40 letters without market words."""
    cleaned = clean_event_title(x)
    pattern = r"(.+?)\s+(?:vs|VS|v|V|@)\.?\s+(.+)"
    both = F.array(*(F.trim(F.regexp_extract(cleaned, pattern, i)) for i in (1, 2)))
    found = F.when(cleaned.rlike(pattern), both).when((cleaned != "") & (F.size(words(cleaned)) <= 4), F.array(cleaned)).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda n: (F.length(n) >= 2) & (F.length(n) <= 40) & ~holds(F.lower(n), TITLE_JUNK))


def sport(x: Column) -> Column:
    """The first rule that fits names the sport; null for excluded titles and unknown ones."""
    low = F.lower(x)
    out = F.when(holds(low, NO_SPORT), F.lit(None).cast("string"))
    for name, parts in SPORTS:
        out = out.when(holds(low, parts), name)
    return out


def region(x: Column) -> Column:
    """The first region whose competitions a text names, else empty."""
    low = F.lower(x)
    out = F.when(F.lit(False), "")
    for name, parts in REGIONS:
        out = out.when(holds(low, parts), name)
    return out.otherwise("")


def parse_json_array(x: Column) -> Column:
    """A JSON array of strings, or the value itself as the only element."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array(x))


def extract_json(x: Column) -> Column:
    """The JSON of an answer: the whole, else a fenced block, else the first flat object."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    flat = F.regexp_extract(x, r"\{[^{}]*\}", 0)
    ok = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c)
    return F.coalesce(ok(x), ok(F.nullif(fenced, F.lit(""))), ok(F.nullif(flat, F.lit(""))))
