"""Work on a few months or hashes at a time, and what it leaves on disk."""

import pathlib
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cleaning
from tallyloom.operators.canonical import to_canonical
from tallyloom.schema import RAW_KEYS, SEQ
from tallyloom.sources import uploads, workspace
from tallyloom.sources.star import FACTS_MAPPING
from tallyloom.sources.store import SalesStore
from tallyloom.sources.uploads import read_upload, write_csv, write_snapshots

MAPPING = {**dict.fromkeys(FACTS_MAPPING), "order_id": "order_id", "sku": "sku", "order_date": "order_date", "quantity": "quantity"}


def batch(spark, rows):
    """Canonical rows from (order, day, quantity), in their order."""
    data = [(order, "s", date.fromisoformat(day) if day else None, quantity, n) for n, (order, day, quantity) in enumerate(rows)]
    df = spark.createDataFrame(data, "order_id string, sku string, order_date date, quantity long, seq int")
    return to_canonical(df, MAPPING, "f", datetime(2024, 1, 1))


def content(store):
    return sorted((r.order_id, str(r.order_date), r.quantity) for r in store.sales().collect())


@pytest.fixture
def store(spark, tmp_path):
    return SalesStore(spark, str(tmp_path / "store"))


FIRST = [("a", "2024-01-01", 1), ("a", "2024-01-01", 2), ("b", "2024-02-01", 3), ("c", "2024-03-01", 4), ("d", None, 5)]
SECOND = [("b", "2024-02-01", 6), ("c", "2024-03-02", 7), ("e", "2024-04-01", 8), ("e", "2024-04-01", 9), (None, "2024-04-01", 9)]


@pytest.mark.parametrize("most", [1, 2**30])
def test_months_are_merged_in_groups(spark, store, monkeypatch, most):
    monkeypatch.setattr(workspace, "PART_BYTES", most)
    writes, write = [], SalesStore._write
    monkeypatch.setattr(SalesStore, "_write", lambda *a: writes.append(a[2]) or write(*a))
    store.replace(batch(spark, FIRST))
    assert content(store) == [("a", "2024-01-01", 2), ("b", "2024-02-01", 3), ("c", "2024-03-01", 4)]
    store.upsert(batch(spark, SECOND))
    assert writes == (["batch/v1"] * 3 + ["batch/v2"] + ["merged/v2"] * 2 if most == 1 else ["batch/v1", "batch/v2", "merged/v2"])
    merged = [("a", "2024-01-01", 2), ("b", "2024-02-01", 6), ("c", "2024-03-01", 4), ("c", "2024-03-02", 7), ("e", "2024-04-01", 9)]
    assert content(store) == merged
    store.append_absent(batch(spark, [*SECOND, ("a", "2024-01-02", 0), ("a", "2024-01-02", 1)]))
    assert content(store) == sorted([*merged, ("a", "2024-01-02", 0)])
    assert tuple(store.health().first())[:2] == (6, 6)
    assert not list(pathlib.Path(workspace.shared_dir(spark)).glob("incoming-*"))


def test_replace_by_keys_without_a_date(spark, store, monkeypatch):
    monkeypatch.setattr(workspace, "PART_BYTES", 1)
    store.replace(batch(spark, [*FIRST[:4], ("a", "2024-05-01", 9)]), ["normalized_order_id"])
    assert content(store) == [("a", "2024-05-01", 9), ("b", "2024-02-01", 3), ("c", "2024-03-01", 4)]
    assert set(store._state()["months"]) == {"2024-02", "2024-03", "2024-05"}


def test_an_empty_batch_leaves_the_months(spark, store):
    store.upsert(batch(spark, FIRST))
    store.upsert(batch(spark, FIRST).where("false"))
    store.append_absent(batch(spark, [("x", None, 1)]), RAW_KEYS)
    assert len(content(store)) == 3
    store.replace(batch(spark, FIRST).where("false"))
    assert store.is_empty()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_changes_leave_no_shuffle_files(spark, store):
    before, setting = shuffle_files(spark), spark.conf.get(workspace.FREED)
    store.upsert(batch(spark, FIRST))
    store.upsert(batch(spark, SECOND))
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert len(shuffle_files(spark) - before) <= 2 and spark.conf.get(workspace.FREED) == setting


def test_groups_keep_to_the_bound(monkeypatch):
    monkeypatch.setattr(workspace, "PART_BYTES", 10)
    assert workspace.grouped({"a": 4, "b": 6, "c": 1, "d": 30, "e": 2}) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert workspace.grouped({}) == []


def test_staged_cleaning_finds_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(workspace, "PART_BYTES", 1)
    lines = [(f" o{n % 7} ", f"2024-01-0{n % 3 + 1}" if n % 5 else None, n) for n in range(60)]
    raw = spark.createDataFrame(lines, f"`Order Id` string, Day string, {SEQ} int")
    mapping = {"order_id": "Order Id", "order_date": "Day"}
    with workspace.Scratch(spark):
        whole, staged = (cleaning.clean_upload(raw, mapping, "yyyy-M-d", staged=s) for s in (False, True))
        assert staged.schema.fieldNames() == whole.schema.fieldNames() and len(staged.inputFiles()) > 1
        assert sorted(map(str, staged.collect())) == sorted(map(str, whole.collect())) and whole.count() == 28
        none = cleaning.clean_upload(raw.where("false"), mapping, "yyyy-M-d", staged=True)
        assert none.count() == 0 and none.columns == staged.columns


def test_snapshots_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(uploads, "PACKED_ROWS", 2)
    rows = [(str(n), 'two\n"lines"' if n == 3 else "é, x") for n in range(5)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1).withColumn(SEQ, F.lit(0))
    for path in write_snapshots(df, df, str(tmp_path), "up", "1"):
        files = list(pathlib.Path(path).glob("part-*"))
        assert len(files) == 3 and all(file.name.endswith(".csv.gz") for file in files)
        assert [(r.a, r.b) for r in read_upload(spark, path).orderBy(SEQ).collect()] == rows
    assert not list(pathlib.Path(write_csv(df.drop(SEQ), str(tmp_path / "plain"))).glob("part-*.gz"))
