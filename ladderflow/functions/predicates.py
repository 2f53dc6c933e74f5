"""Predicates of record linkage and of trading gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladderflow.functions import text as T

#: Categories that may be traded and tags that may not.
VIABLE = "soccer tennis basketball american_football ice_hockey esports teams unknown ncaa baseball".split()
BLOCKED_TAGS = "politics pop-culture crypto science entertainment".split()


#: Names of soccer leagues, words of other leagues, words of regions.
LEAGUES = {
    "premier-league": ("premier league", "england premier league"), "la-liga": ("la liga", "laliga"), "serie-a": ("serie a", "italy serie a"), "bundesliga": ("bundesliga",),
    "ligue-1": ("ligue 1", "ligue1"), "ucl": ("champions league", "uefa champions league"), "europa-league": ("europa league", "uefa europa league"),
}
LEAGUE_WORDS = {"nba": ("nba",), "wnba": ("wnba",), "ncaa": ("ncaa", "college"), "atp": ("atp",), "wta": ("wta",), "mlb": ("mlb", "major league"), "nfl": ("nfl",), "nhl": ("nhl", "hockey")}
REGION_WORDS = {
    "england": ("england", "premier league", "efl", "fa cup"), "spain": ("spain", "la liga", "laliga", "copa del rey"), "italy": ("italy", "serie a", "coppa italia"),
    "germany": ("germany", "bundesliga", "dfb"), "france": ("france", "ligue 1", "ligue1"), "usa": ("usa", "mlb", "nba", "nfl", "nhl", "wnba"),
}


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def within_day(a: Column, b: Column) -> Column:
    """Less than 24 hours apart; true if either is unknown."""
    return F.coalesce(F.abs(_micros(a) - _micros(b)) < 86_400_000_000, F.lit(True))


def within_hours(a: Column, b: Column, hours: float = 12.0) -> Column:
    """At most so many hours apart; true if either is unknown."""
    return F.coalesce(F.abs(_micros(a) - _micros(b)) <= int(hours * 3_600_000_000), F.lit(True))


def same_day(a: Column, b: Column, days: int = 2) -> Column:
    """At most so many days apart; false if either is unknown."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def compatible_types(question: Column, market_type: Column, name: Column) -> Column:
    """A title and a market of one kind, lines equal to 0.01; an empty type passes."""
    low = F.lower(question)
    total, spread, both = (T.holds(low, p) for p in (T.TOTAL_WORDS, T.SPREAD_WORDS, T.BOTH_SCORE_WORDS))
    special = T.holds(market_type, ("OVER_UNDER", "HANDICAP", "BOTH_TEAMS_TO_SCORE"))
    kind = (
        F.when(total, market_type.contains("OVER_UNDER")).when(spread, market_type.contains("HANDICAP")).when(both, market_type.contains("BOTH_TEAMS_TO_SCORE"))
        .otherwise(~special & market_type.isin("MATCH_ODDS", "WINNER", "MONEY_LINE", "HEAD_TO_HEAD"))
    )
    lines = F.coalesce(F.abs(T.line_value(low) - T.line_value(F.lower(name))) <= 0.01, F.lit(False))
    return F.coalesce(market_type, F.lit("")).eqNullSafe("") | (kind & F.when(total | spread, lines).otherwise(True))


def compatible_structures(a: Column, b: Column) -> Column:
    """P10: scope and kind equal, and the subtype for props."""
    x, y = T.structure(a), T.structure(b)
    return (x["scope"] == y["scope"]) & (x["kind"] == y["kind"]) & ((x["kind"] != "player_prop") | (x["subtype"] == y["subtype"]))


def compatible_totals(question: Column, outcome: Column, name: Column) -> Column:
    """Totals need the same line, draws need a draw."""
    kind, low = T.market_type(question), F.lower(name)
    asked = F.coalesce(T.totals_spec(question)["line"], T.totals_spec(outcome)["line"])
    is_total = (kind == "TOTALS") | T.holds(low, ("over", "under"))
    return F.when(is_total, F.coalesce(asked == T.totals_spec(name)["line"], F.lit(False))).when(kind == "DRAW", T.holds(low, ("draw", "tie"))).otherwise(True)


def runners_ok(kind: Column, runners: Column, sport_id: Column) -> Column:
    """A soccer winner market must not have two runners."""
    return ~((kind == "WINNER") & (sport_id == "1") & (runners == 2))


def liquid(a: Column, b: Column, least: float = 10.0) -> Column:
    """Both sides hold at least so much."""
    return F.least(a, b) >= least


def consistent(a: Column, b: Column, most: float = 0.2) -> Column:
    """Two prices of one thing are not too far apart."""
    return F.abs(a - b) <= most


def viable(category: Column, tags: Column) -> Column:
    """P20: an allowed category without a blocked tag."""
    return F.lower(category).isin(*VIABLE) & ~F.exists(tags, lambda t: F.lower(t).isin(*BLOCKED_TAGS))


def cross_check(slug: Column, category: Column, name: Column, competition: Column, region: Column, sport: Column) -> Column:
    """A market and an event are of one league and region. College and professional basketball never meet; a soccer
    league, or a league's words, in the market must stand in the event's competition, if that is known; so must the
    region's."""
    slug, category, name, competition, region = (F.lower(F.coalesce(x, F.lit(""))) for x in (slug, category, name, competition, region))
    clash = (T.holds(slug, ("ncaab", "college-basketball")) & name.contains("nba")) | (slug.contains("nba") & T.holds(name, ("ncaa", "college basketball")))
    for key, names in LEAGUES.items():
        clash = clash | ((sport == "soccer") & T.holds(slug, (key, *names)) & (competition != "") & ~T.holds(competition, names))
    for words in LEAGUE_WORDS.values():
        clash = clash | ((competition != "") & (T.holds(slug, words) | T.holds(category, words)) & ~T.holds(competition, words))
    for key, words in REGION_WORDS.items():
        clash = clash | ((region != "") & (T.holds(slug, words) | T.holds(category, words)) & (region != key))
    return ~clash


def worth_alert(liquidity_ok: Column, edge: Column, least: float) -> Column:
    """An opportunity that can be traded and pays at least so much."""
    return liquidity_ok & (edge >= least)


def triage(score: Column) -> Column:
    """What happens to a suggestion."""
    return F.when(score >= 0.75, "auto").when(score >= 0.6, "medium").otherwise("weak")
