"""Schemas of raw feeds and of the canonical tables."""

TOKEN = "struct<outcome:string,price:double,token_id:string>"
#: A raw market as landed, with every alternative key nullable.
RAW_MARKET = (
    "id string, conditionId string, condition_id string, question string, title string, slug string, category string, volume string, liquidity string, "
    "gameStartTime string, startDate string, endDate string, outcomes string, outcomePrices string, clobTokenIds string, closed boolean, tags array<string>"
)
#: A raw event with its markets.
RAW_EVENT = f"id string, title string, markets array<struct<id:string,question:string,closed:boolean,tokens:array<{TOKEN}>>>"
#: A raw catalogue row of an exchange.
RAW_CATALOGUE = "marketId string, marketName string, marketStartTime string, competition struct<id:string,name:string>, event struct<id:string,name:string>, description struct<marketType:string>, runners array<struct<selectionId:bigint,runnerName:string>>"
#: A raw price-ladder row.
RAW_PRICES = "marketId string, isMarketDataDelayed boolean, runners array<struct<selectionId:bigint,lastPriceTraded:double,ex:struct<availableToBack:array<struct<price:double,size:double>>,availableToLay:array<struct<price:double,size:double>>>>>"
#: A raw maker order.
RAW_ORDER = "marketHash string, orderStatus string, percentageOdds string, totalBetSize string, fillAmount string, isMakerBettingOutcomeOne boolean"
#: The canonical market.
EXCHANGE_MARKET = "id string, name string, competition string, open_date timestamp, market_type string, exchange string, runners array<struct<selection_id:string,name:string,price:double>>"
SNAPSHOT = "timestamp string, condition_id string, token_id string, outcome string, mid_price double, best_bid double, best_ask double, bid_depth double, ask_depth double, spread double"
TICK = "platform string, market_id string, best_bid double, best_ask double, bid_size double, ask_size double, ts timestamp"
PAPER_METRICS = "timestamp timestamp, token_id string, position double, trades int, pnl_virtual double, drawdown double, total_trades int, total_profit double, total_loss double, unrealized_equity double"
ODDS_HISTORY = "Date string, HomeTeam string, AwayTeam string, FTR string, B365H double, B365D double, B365A double"
LEARNING_EVENT = "timestamp string, event_type string, data struct<left:string,right:string,score:double>"
