"""Prices, odds, fees and stakes as column expressions.

Each function takes and gives columns and has no side effects, so Catalyst keeps it within whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exchange rates against the dollar.
FX = {"USD": 1.0, "EUR": 0.92, "GBP": 0.78}
#: Largest epoch in seconds; larger numbers are milliseconds.
LAST_SECOND = 4_102_444_800


def half_up(x: Column, digits: int) -> Column:
    """Rounds to digits, ties up."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def decimal_odds(price: Column) -> Column:
    """Probability to decimal odds; 1000 for prices up to 0 and 1.01 from 1 on."""
    return F.when(price <= 0, 1000.0).when(price >= 1, 1.01).otherwise(half_up(1 / price, 3))


def implied_probability(odds: Column) -> Column:
    """1 / odds, 0 for odds that are not positive."""
    return F.when(odds <= 0, 0.0).otherwise(1 / odds)


def after_commission(odds: Column, rate: float = 0.02) -> Column:
    """Odds after a commission on winnings."""
    return 1 + (odds - 1) * (1 - rate)


def expected_value(probability: Column, odds: Column, rate: float = 0.02) -> Column:
    """Expected value of a unit stake after commission."""
    return probability * after_commission(odds, rate) - 1


def hedged_roi(ask: Column, odds: Column, fee: float = 0.02) -> Column:
    """Return in percent of buying at the ask and hedging at the odds; null for prices up to 0 and odds up to 1."""
    net = after_commission(odds, fee)
    cost = ask + 1 / net
    return F.when((ask > 0) & (odds > 1) & (net > 1), (1 / cost - 1) * 100)


def lay_hedge_roi(price: Column, lay: Column, fee: float = 0.02) -> Column:
    """Return in percent of buying at the price and laying at the odds."""
    hedge = (lay - 1) / (lay - fee)
    return F.when((price > 0) & (lay > 1), (1 / (price + hedge) - 1) * 100)


def ev_net(probability: Column, odds: Column, stake: float = 100.0, gas: float = 0.05, rate: float = 0.02) -> Column:
    """Expected value in currency: edge on the stake less gas and commission on the stake."""
    return (probability - implied_probability(odds)) * stake - gas - stake * rate


def odds_ratio_roi(back: Column, lay: Column) -> Column:
    """(back - lay) / lay in percent."""
    return F.when(lay > 0, (back - lay) / lay * 100)


def strip_fees(spread_pct: Column, fees: float = 7.0) -> tuple[Column, Column]:
    """The spread less all fees, signed, and its absolute value, taken after the fees are off."""
    net = spread_pct.cast("decimal(20,8)") - F.lit(fees).cast("decimal(20,8)")
    return net, F.abs(net)


def merge_split_profit(entry: Column, exit_: Column, fee: float = 0.02) -> Column:
    """Gross less a fee on positive gross, in percent of the entry."""
    gross = exit_ - entry
    return F.when(entry > 0, (gross - F.greatest(gross, F.lit(0.0)) * fee) / entry * 100)


def kelly_fraction(win: Column, profit_ratio: Column) -> Column:
    """(b p - q) / b, at least 0; 0 for a ratio that is not positive."""
    return F.when(profit_ratio > 0, F.greatest(F.lit(0.0), (profit_ratio * win - (1 - win)) / profit_ratio)).otherwise(0.0)


def kelly_size(bankroll: Column, win: Column, profit_ratio: Column, fraction: float = 0.25, cap: float = 0.05, liquidity: Column | None = None, least: float = 0.0) -> Column:
    """Fractional Kelly stake, capped by a share of the bankroll and by liquidity; 0 below the least bet."""
    size = F.least(kelly_fraction(win, profit_ratio) * fraction, F.lit(cap)) * bankroll
    if liquidity is not None:
        size = F.least(size, liquidity)
    return F.when(size < least, 0.0).otherwise(size)


def kelly_from_edge(bankroll: Column, edge_pct: Column, win: Column, cap: float = 0.05, least: float = 5.0) -> Column:
    """Stake from an edge in percent; 0 if there is no edge, no bankroll or less than the least bet."""
    size = F.least(kelly_fraction(win, edge_pct / 100) * bankroll, bankroll * cap)
    return F.when((edge_pct <= 0) | (bankroll <= 0) | (size < least), 0.0).otherwise(size)


def convert(amount: Column, source: Column, target: Column) -> Column:
    """Between currencies by the fixed table, two digits; null for unknown ones."""
    rates = F.create_map(*[F.lit(x) for kv in FX.items() for x in kv])
    return half_up(amount / rates[source] * rates[target], 2)


def gas_usd(base_gwei: Column, limit: Column, price: Column) -> Column:
    """Cost of a transaction with a tip of 30 gwei."""
    return (base_gwei + 30) * 1e9 * limit / 1e18 * price


def paper_pnl(expected: Column, size: Column, slip: float = 0.01, fee_a: float = 0.02, fee_b: float = 0.02) -> Column:
    """Expected profit less slippage on both legs and fees on the profit."""
    return expected - size * 2 * slip - expected * (fee_a + fee_b)


def slippage_pct(executed: Column, expected: Column) -> Column:
    """Distance from the expected price in percent; 0 without one."""
    return F.when(expected > 0, F.abs(executed - expected) / expected * 100).otherwise(0.0)


def is_worse(side: Column, new: Column, reference: Column) -> Column:
    """A higher price is worse for a buyer, a lower one for a seller."""
    return F.when(side == "BUY", new > reference).otherwise(new < reference)


def dynamic_ttl(volatility: Column) -> Column:
    """Seconds that a result stays valid, from an hour down to five minutes."""
    return (3600 - 3300 * volatility).cast("int")


def skewed_price(true: Column, inefficiency: float) -> Column:
    """A price pulled towards one half."""
    return true + (0.5 - true) * inefficiency


def drift(now: Column, initial: Column) -> Column:
    """Relative distance from the initial price."""
    return F.when(initial > 0, F.abs(now - initial) / initial)


def epoch_timestamp(x: Column) -> Column:
    """Seconds or milliseconds since 1970."""
    return F.timestamp_seconds(F.when(x > LAST_SECOND, x / 1000).otherwise(x))


def sigmoid(z: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-z))


def kl_divergence(mu: Column, theta: Column, eps: float = 1e-12) -> Column:
    """Sum of mu ln(mu / theta) over two arrays, both clipped from below."""
    term = lambda a, b: F.greatest(a, F.lit(eps)) * F.log(F.greatest(a, F.lit(eps)) / F.greatest(b, F.lit(eps)))
    return F.aggregate(F.zip_with(mu, theta, term), F.lit(0.0), lambda s, x: s + x)


def log_barrier(mu: Column, eps: float = 1e-12) -> Column:
    """-sum of ln mu + ln (1 - mu)."""
    clip = lambda a: F.greatest(a, F.lit(eps))
    return -F.aggregate(mu, F.lit(0.0), lambda s, x: s + F.log(clip(x)) + F.log(clip(1 - x)))


def ev_gate(prices: Column, payout: float = 1.0, fee: float = 0.5, slip: float = 0.3) -> Column:
    """P25: edge of buying all outcomes at the prices, in percent, less fee and slippage."""
    cost = F.aggregate(prices, F.lit(0.0), lambda s, x: s + x)
    return F.when(cost > 0, (payout - cost) / cost * 100 - fee - slip)
