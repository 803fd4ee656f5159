"""Schemas of the tables that come in from files."""

from __future__ import annotations

BARS = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double"
TRADES = "trade_id long, symbol string, timestamp timestamp, price double, quantity double, side string"
QUOTES = "symbol string, timestamp timestamp, bid double, ask double, bid_size double, ask_size double"
#: The shape of a collected candle line.
CANDLE_LINE = "collected_at string, spread_bps double, candle struct<time:string,open:string,high:string,low:string,close:string,baseVol:string,quoteVol:string>"
#: The shape of a recorded message line.
MESSAGE_LINE = "received_at string, message struct<ch:string,symbol:string,ts:bigint,data:string>"
#: The state that a stream keeps of a symbol.
STREAM_STATE = "struct<best_bid:string,best_ask:string,spread_bps:string,depth_half_percent:string,mark_price:string,index_price:string,funding_rate:string,funding_interval_hours:string,buy_volume:string,sell_volume:string,trade_count:bigint,updated_at:string>"
CONTRACT = "symbol string, base string, quote string, status string, tick_size double, lot_size double, minimum_quantity double, minimum_notional double, maximum_leverage double"
EQUITY = "account string, timestamp timestamp, equity double"
