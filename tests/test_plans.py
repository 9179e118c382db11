"""Properties of physical plans that matter at scale."""

import contextlib
import io
import pathlib
import re

import pytest

from checks import queries
from tallyloom.operators import dedup, mapping, products, revenue
from tallyloom.schema import UPSERT_KEYS
from tallyloom.sources import star

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("simple")
    return shown.getvalue()


def test_hot_keys_collapse_before_the_shuffle(spark):
    rows = queries.stored(spark, FOLDER)
    for df in (dedup.keep_last(rows, UPSERT_KEYS), dedup.sample_per_value(rows, "transaction_type", ["Refund"])):
        text = plan(df)
        assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    cells = star.supplier_cells(spark, FOLDER, ["Order Date"])
    text = plan(mapping.profile(cells))
    assert "HashAggregate" in text and "Window" not in text and "SortAggregate" not in text


def test_summary_reads_its_rows_once(spark):
    text = plan(revenue.revenue_summary(queries.facts(spark, FOLDER)))
    assert len(re.findall(r"FileScan parquet.*lineitem", text)) == 1
    assert "l_shipdate" not in text and "p_name" not in text


def test_top_k_is_not_a_full_sort(spark):
    text = plan(products.top_products(products.product_totals(queries.facts(spark, FOLDER))))
    assert "TakeOrderedAndProject" in text


def test_no_cross_joins_and_no_python(spark):
    for name in ("revenue_summary", "revenue_nonderived", "wow_change", "kpi_bundle", "header_candidates"):
        text = plan(queries.all_queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


OWN = [path for path in sorted(pathlib.Path("tallyloom").rglob("*.py")) if "llm" not in path.parts]


@pytest.mark.parametrize("path", OWN, ids=str)
def test_library_has_no_udfs(path):
    source = path.read_text()
    assert not re.search(r"udf|localCheckpoint|crossJoin|toPandas|\.rdd\b", source)


def test_sales_view_has_one_join_tree(spark):
    text = plan(star.sales(spark, FOLDER))
    assert "RoundRobin" not in text and len(re.findall(r"FileScan parquet.*lineitem", text)) == 1


def test_queries_evaluate_the_view_once(spark):
    for name in ("upsert_into_stored", "append_counts", "duplicate_precheck", "question_answers"):
        assert "lineitem" not in plan(queries.all_queries()[name](spark, FOLDER))
