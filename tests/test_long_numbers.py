"""References whose numbers grow with a table's keys."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as e
from lodeseek.functions import text as T


def test_long_arxiv_numbers_are_taken_whole(spark):
    rows = spark.createDataFrame([("as arXiv: 2401.109999v2 says, and arx1v:2401.1234567",)], "t string")
    assert [r.value for r in rows.select(F.explode(T.references("t")).alias("value")).collect()] == ["arxiv:2401.109999v2", "arxiv:2401.1234567"]


def test_repeated_keys_give_each_value_once(spark, tmp_path):
    rows = spark.range(2).selectExpr("CAST(id + 120000 AS BIGINT) AS p_partkey", "CAST(5 AS INT) AS p_size")
    rows.union(rows).write.parquet(f"{tmp_path}/part.parquet")
    found = [tuple(r) for r in e.queries()["d16_references"](spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) == 24 and (120000, "arxiv:2401.130000v2") in found
