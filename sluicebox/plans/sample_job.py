"""The sample-data job: customers, transactions and a table with anomalies, written as CSV."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluicebox.operators.corrupt import inject_anomalies
from sluicebox.operators.generate import ROW, generate_customers, generate_for, generate_transactions
from sluicebox.operators.sinks import write_csv

SEED = 42
ANOMALY_SCHEMA = {"id": "int", "name": "name", "email": "email", "amount": "amount", "date": "date"}


def write_samples(
    spark: SparkSession, folder: str, customers: int = 1000, transactions: int = 5000, anomalous: int = 500,
    anomaly_rate: float = 0.10, seed: int = SEED, as_of: dt.datetime | None = None,
) -> dict[str, str]:
    """Write the three sample tables below ``folder``; returns their paths by name."""
    as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    options = {"seed": seed, "as_of": as_of}
    # The ids of this table repeat, so its rows are identified by their number, which is left out of the result.
    clean = generate_for(spark.range(anomalous), ["id"], ANOMALY_SCHEMA, keep=[F.col("id").alias(ROW)], stream="anomalies.", **options)
    kinds = ["nulls", "outliers", "duplicates"]
    spoiled = inject_anomalies(clean, [ROW], anomaly_rate, kinds, seed, drop_key=True)
    tables = {
        "customers": generate_customers(spark, customers, **options),
        "transactions": generate_transactions(spark, transactions, **options),
        "data_with_anomalies": spoiled,
    }
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        write_csv(df, paths[name])
    return paths

