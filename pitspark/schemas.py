"""Declared schemas; no reader infers one. Raw tables are strings, because each parse rule (drop the
row, or null the field) is part of the result."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _typed(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, D, DT, L, B = T.StringType(), T.DoubleType(), T.DateType(), T.LongType(), T.BooleanType()

RAW_ESTIMATES = _strings("row_id", "OFTIC", "CNAME", "FPEDATS", "ANNDATS", "REVDATS", "VALUE", "ANALYS", "FPI", "MEASURE", "ANNDATS_ACT")
RAW_PRICES = _strings("TICKER", "COMNAM", "date", "PRC", "CFACPR", "RET", "SHROUT")
RAW_SUPPLEMENT = _strings("ticker", "date", "adj_close", "ret")
RAW_FUNDQ = _strings("tic", "datadate", "rdq", "saleq", "oibdpq", "niq", "oancfy", "capxy", "ceqq", "dlttq", "dlcq", "cheq")
RAW_MACRO = _strings("date", "value")
RAW_BENCHMARKS = _typed(date=DT, XES=D, VOO=D)
RAW_PERMITS = _strings(
    "pad_id", "operator_at_permit", "operator_normalized", "state", "county", "latitude", "longitude",
    "permit_filing_date", "spud_filing_date", "completion_filing_date", "api_number",
)
RAW_FRACTION = _strings("ticker", "fiscal_year", "permian_production_fraction_ttm", "permian_fraction_ttm")
RAW_EARNINGS = _strings("ticker", "fiscal_quarter_end", "earnings_date_actual")
RAW_TRUTH = _strings("pad_id", "event_date")
RAW_ARTICLES = _strings("seendate", "title", "url")

SAR_OBS = _typed(pad_id=S, lat=D, lon=D, scene_id=S, acquisition_date=DT, vv_mean_linear=D, vv_mean_db=D, vh_mean_linear=D)
SAR_FILE = T.ArrayType(SAR_OBS)
PAD_STATE = _typed(pad_id=S, state=S)
CELLS = _typed(
    ticker=S, fiscal_quarter_end=DT, decision_date_T=DT, decision=S, conviction_tier=S, final_size_pct=D,
    low_quality_flag=B, error=S,
)
SIGNALS = _typed(ticker=S, fiscal_quarter_end=DT, decision_date_T=DT, direction=S, size_pct=D, error=S)
OPINION = _typed(role=S, direction=S, confidence=S, key_evidence=T.ArrayType(S), counter_evidence=T.ArrayType(S), reasoning_short=S)
