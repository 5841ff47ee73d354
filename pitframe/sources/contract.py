"""The typed landing contract: what the flatten jobs write and the feature jobs read, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, StringType

NUMBER = (DecimalType, DoubleType, FloatType, LongType, IntegerType)
KINDS = {"text": (StringType,), "day": (DateType,), "number": NUMBER, "count": (IntegerType, LongType)}

#: Columns by table; keys first.
TABLES = {
    "insider_transaction": {"ticker": "text", "accession_number": "text", "transaction_side": "text", "transaction_ordinal": "count", "filed_at": "day", "transaction_date": "day", "reporting_owner_cik": "text", "reporting_owner_name": "text", "transaction_code": "text", "acquired_or_disposed": "text", "shares_amount": "number", "price_per_share": "number", "total_value": "number"},
    "institutional_holding": {"ticker": "text", "report_date": "day", "holder_name": "text", "shares": "number"},
    "sentiment_daily": {"ticker": "text", "date": "day", "article_count": "count", "sentiment_score": "number"},
    "events_calendar": {"ticker": "text", "event_type": "text", "event_date": "day"},
    "earnings_history": {"ticker": "text", "period_end": "day", "report_date": "day", "surprise_fraction": "number"},
}


def conform(rows: DataFrame, table: str) -> DataFrame:
    """The rows with the columns of the contract in their order, numbers as doubles; a column that is missing or of another kind is an error that names it."""
    have, wrong = {f.name: f.dataType for f in rows.schema.fields}, []
    for name, kind in TABLES[table].items():
        if name not in have:
            wrong.append(f"{name} is missing")
        elif not isinstance(have[name], KINDS[kind]):
            wrong.append(f"{name} is {have[name].simpleString()}, not {kind}")
    if wrong:
        raise ValueError(f"{table}: {'; '.join(wrong)}")
    return rows.select(*(F.col(c).cast("double").alias(c) if k == "number" else F.col(c) for c, k in TABLES[table].items()))
