"""Schemas of the records, and the columns of each feature."""

from __future__ import annotations

from pyspark.sql import types as T

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("security", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("trad_time", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("bid_seq", T.LongType()),
        T.StructField("offer_seq", T.LongType()),
        T.StructField("side", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

ORDER_SCHEMA = T.StructType(
    [
        T.StructField("security", T.StringType()),
        T.StructField("order_time", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("side", T.IntegerType()),
        T.StructField("appl_seq", T.LongType()),
    ]
)

_LADDER = T.ArrayType(T.DoubleType())
DEPTH_SCHEMA = T.StructType(
    [
        T.StructField("security", T.StringType()),
        T.StructField("depth_time", T.TimestampNTZType()),
        *(T.StructField(n, T.DoubleType()) for n in ("prev_close", "open", "high", "low", "last", "volume", "amount")),
        *(T.StructField(n, _LADDER) for n in ("ask_price", "ask_volume", "bid_price", "bid_volume")),
    ]
)

#: Columns of each feature, in output order.
DEBUG_COLUMNS = ["amount", "count", "term_count"]
CANDLE_COLUMNS = [
    "cjb", "bcjb", "scjb", "volume_nfq", "bvolume_nfq", "svolume_nfq", "amount", "bamount", "samount",
    "lowprice_nfq", "highprice_nfq", "openprice_nfq", "closeprice_nfq",
]
TRADE_AMOUNT_COLUMNS = [
    "ultraBuyAmt", "ultraSellAmt", "ultraOrderchg", "bigBuyAmt", "bigSellAmt", "bigOrderchg", "ultrabigOrderchg",
    "midBuyAmt", "midSellAmt", "midOrderchg", "smallBuyAmt", "smallSellAmt", "smallOrderchg",
]
ORDER_FLOW_COLUMNS = [
    "Sv", "Scjbs", "Bv", "Bcjbs", "tradv", "cjbs", "Samt", "Bamt", "tradamt", "CumTradv", "CumCjbs", "CumTradamt",
    "Delta", "cjbsDelta", "MaxDeltaStrength", "cjbsMaxDeltaStrength", "MinDeltaStrength", "cjbsMinDeltaStrength",
    "DeltaStrength_MinMaxRatio", "cjbsDeltaStrength_MinMaxRatio", "CumDelta", "CumCjbsDelta",
    "DeltaStrength", "cjbsDeltaStrength", "CumDeltaStrength", "CumCjbsDeltaStrength",
    "DeltaStrength_avg", "cjbsDeltaStrength_avg", "SD_ratio_avg", "SDcjbs_ratio_avg", "SD_ratio_max", "SDcjbs_ratio_max",
    "SD_ratio_min", "SDcjbs_ratio_min", "SD_ratio", "SDcjbs_ratio",
    "S_equilibrium_P", "Scjbs_equilibrium_P", "D_equilibrium_P", "Dcjbs_equilibrium_P",
    "S_equilibrium", "Scjbs_equilibrium", "D_equilibrium", "Dcjbs_equilibrium",
    "S_equilibrium_ratio", "Scjbs_equilibrium_ratio", "D_equilibrium_ratio", "Dcjbs_equilibrium_ratio",
    "S_equilibrium_count", "Scjbs_equilibrium_count", "D_equilibrium_count", "Dcjbs_equilibrium_count",
    "POC", "cjbsPOC", "SPOC", "ScjbsPOC", "BPOC", "BcjbsPOC", "Svwap", "Bvwap",
    "S_orderDecay", "Scjbs_orderDecay", "D_orderDecay", "Dcjbs_orderDecay",
    "S_decaySlope", "Scjbs_decaySlope", "D_decaySlope", "Dcjbs_decaySlope",
]
FEATURE_COLUMNS = {
    "debug_trade": DEBUG_COLUMNS,
    "candle_stick": CANDLE_COLUMNS,
    "trade_amount_dollar": TRADE_AMOUNT_COLUMNS,
    "trade_amount_std": TRADE_AMOUNT_COLUMNS,
    "trade_amount_quantile": TRADE_AMOUNT_COLUMNS,
    "order_flow_min": ORDER_FLOW_COLUMNS,
    "order_flow_min_big": ORDER_FLOW_COLUMNS,
    "order_flow_min_small": ORDER_FLOW_COLUMNS,
}
