"""How often rows are written or shuffled on their way."""

from pyspark.sql import functions as F

from checks import queries
from tallyloom.operators import dedup, upsert


def test_stored_rows_are_shuffled_once_for_the_merge(spark, monkeypatch):
    staged, stage = [], queries.stage
    monkeypatch.setattr(queries, "stage", lambda df, name: staged.append(name) or stage(df, name))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = queries.upsert_into_stored(spark, "/root/testdata/sf0.001")
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert staged == ["rows", "second"]
    assert plan.count("Exchange hashpartitioning") == 2  # the stored rows by key, and the keys of the batch


def test_append_report_reads_its_batch_once(spark, tmp_path):
    rows = [("1", "a"), ("1", "a"), ("2", "a"), (None, "a"), (None, "a")]
    spark.createDataFrame(rows, "order_id string, sku string").write.parquet(f"{tmp_path}/batch")
    stored = spark.createDataFrame([("1", "a"), (None, "a")], "order_id string, sku string")
    report = upsert.append_report(stored, spark.read.parquet(f"{tmp_path}/batch"), ["order_id", "sku"])
    assert tuple(report.first()) == (1, 2, 2)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_keys_are_checked_once_each(spark):
    rows = spark.createDataFrame([(" a ", None), ("", "b"), ("c", "d")], "k string, l string")
    checked = rows.select(F.upper("k").alias("k"), "l").where(dedup.valid_keys(["k", "l"]))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert [row["l"] for row in checked.collect()] == ["d"]
    assert next(line for line in plan.split("\n") if "Filter" in line).count("upper(") == 1


def test_positions_are_counted_in_words_of_rows(spark):
    places = [("1", "f", 0, 0), ("1", "f", 0, 0), ("2", "f", 0, 63), ("2", "f", 0, 64), (None, "f", 9, 64), ("3", "g", 0, 2**40)]
    columns = "`Order Id` string, path string, block long, row long"
    rows = spark.createDataFrame(places, columns).selectExpr(
        "`Order Id`", "'1.5' AS `Invoice Amount`", "if(row = 64, 'x', '2024-01-02') AS `Invoice Date`", "struct(path, block, row) AS seq"
    )
    found = queries.totals_read_back(rows)
    counted = found.first()
    assert (counted.rows, counted.orders, counted.positions, counted.undated, counted.missing_amounts) == (6, 3, 5, 2, 0)
    assert float(counted.amount) == 9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "word" in plan.split("Aggregate [")[2].split("]")[0]
    none = queries.totals_read_back(rows.where("`Order Id` = '4'")).first()
    assert (none.rows, none.orders, none.amount, none.positions) == (0, 0, None, 0)
