"""Tables of more rows than a sheet holds go through the queries whole."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tabloom.functions.cells import MAX_ROWS

ROWS = MAX_ROWS + 1_000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Tables a little longer than a sheet, one part each: what is one partition doesn't fit one workbook."""
    folder = tmp_path_factory.mktemp("large")
    k = F.col("id")
    at = (k % 1_000_000 + 1_600_000_000).cast("timestamp")
    tables = {
        "orders": [k.alias("o_orderkey"), (k % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (k / 4).alias("o_totalprice"),
            at.cast("timestamp_ntz").alias("o_orderdate"), F.when(k % 2 == 0, "2-HIGH").otherwise("5-LOW").alias("o_orderpriority")],
        "events": [(k * 2).alias("event_id"), at.alias("ts"), k.alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")],
        "lineitem": [k.alias("l_orderkey"), F.lit("N").alias("l_returnflag"), F.lit(1.0).alias("l_quantity"), at.alias("l_shipdate")],
        "part": [k.alias("p_partkey"), F.lit("brand").alias("p_brand"), F.lit(7).alias("p_size")],
    }
    for name, columns in tables.items():
        spark.range(ROWS).coalesce(1).select(*columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


KEYS = ROWS * (ROWS - 1) // 2

#: A column of each query's result, and what its values have to sum up to.
SUMS = {
    "xlsx_data_named_like_places": ("row_index", sum(range(5002, ROWS, 2))),
    "events_stream_tumbling": ("events", ROWS),
    "xlsx_late_types": ("p_partkey", KEYS),
    "xlsx_roundtrip_events": ("event_id", 2 * KEYS),
    "xlsx_dates_as_instants": ("o_orderkey", KEYS),
    "xlsx_records_default": ("event_id", 2 * KEYS),
    "xlsx_roundtrip_orders": ("o_orderkey", KEYS),
    "xlsx_dates_as_serials": ("o_orderkey", KEYS),
    "xlsx_roundtrip_1904": ("o_orderkey", KEYS),
    "xlsx_shares_of_a_sheet": ("rows", ROWS),
}


@pytest.mark.parametrize("name", SUMS)
def test_no_row_is_lost(spark, large, name):
    column, wanted = SUMS[name]
    assert __spark_entry__.queries()[name](spark, large).agg(F.sum(column)).first()[0] == wanted
