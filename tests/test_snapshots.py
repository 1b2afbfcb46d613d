"""Stores of versioned tables: visibility, failed writers, conflicts, pruned reads."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.plans.estimate import create_store, replace_lines
from tallyspark.sources import snapshots


@pytest.fixture()
def store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("project_id"), F.col("id"), (F.col("id") * 1.0).alias("total")
    )
    commit = snapshots.begin(spark, root)
    commit.create("lines", rows, "project_id", rows_per_bucket=100)
    assert commit.finish() == 1
    return root, rows


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


def test_created_table_and_bucket_count(spark, store):
    root, rows = store
    same(snapshots.read(spark, root, "lines"), rows)
    assert snapshots.manifest(spark, root)[1]["lines"].buckets == 9


def test_large_tables_have_no_more_folders(spark, tmp_path):
    """Buckets beyond the greatest number hold more rows; all are read, and replaced by their keys."""
    root = f"file://{tmp_path}/large"
    rows = spark.range(3000).select((F.col("id") % 1500).alias("project_id"), "id")
    commit = snapshots.begin(spark, root)
    commit.create("lines", rows, "project_id", rows_per_bucket=2)
    commit.finish()
    table = snapshots.manifest(spark, root)[1]["lines"]
    assert table.buckets == 256 and len(table.folders) <= 256
    same(snapshots.read(spark, root, "lines"), rows)
    commit = snapshots.begin(spark, root)
    commit.replace("lines", rows.limit(0), rows.where("project_id < 700").select("project_id"))
    commit.finish()
    same(snapshots.read(spark, root, "lines"), rows.where("project_id >= 700"))


def test_one_key_scans_one_bucket(spark, store):
    root, rows = store
    found = snapshots.read(spark, root, "lines", keys=[7])
    same(found, rows.where("project_id = 7"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert snapshots.read(spark, root, "lines", keys=[12345]).count() == 0


def test_replace_and_old_version(spark, store):
    root, rows = store
    commit = snapshots.begin(spark, root)
    scope = spark.createDataFrame([(7,), (8,), (5000,)], "project_id long")
    new = spark.createDataFrame([(7, -1, 0.5), (5000, -2, 1.5)], "project_id long, id long, total double")
    commit.replace("lines", new, scope)
    same(snapshots.read(spark, root, "lines"), rows)  # not visible yet
    assert commit.finish() == 2
    same(snapshots.read(spark, root, "lines"), rows.where("project_id NOT IN (7, 8)").union(new))
    same(snapshots.read(spark, root, "lines", version=1), rows)
    untouched = set(snapshots.manifest(spark, root, 1)[1]["lines"].folders.items()) & set(snapshots.manifest(spark, root)[1]["lines"].folders.items())
    assert untouched  # buckets outside the scope are not rewritten


def test_failed_writer_leaves_the_old_version(spark, store):
    root, rows = store
    commit = snapshots.begin(spark, root)
    broken = rows.withColumn("total", F.when(F.col("id") == 500, F.raise_error(F.lit("lost"))).otherwise(F.col("total")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        commit.replace("lines", broken, rows.select("project_id"))
    same(snapshots.read(spark, root, "lines"), rows)
    assert snapshots.versions(spark, root) == [1]


def test_second_writer_conflicts(spark, store):
    root, rows = store
    first, second = snapshots.begin(spark, root), snapshots.begin(spark, root)
    more = rows.where("id < 10").withColumn("id", F.col("id") + 10_000)
    first.append("lines", more)
    second.replace("lines", more.limit(0), rows.select("project_id"))
    first.finish()
    with pytest.raises(snapshots.Conflict):
        second.finish()
    same(snapshots.read(spark, root, "lines"), rows.union(more))
    assert [n for n in snapshots._names(spark, f"{root}/manifest") if n.startswith(".") and not n.endswith(".crc")] == []


def test_null_keys_emptied_tables_rebucket_and_vacuum(spark, store):
    root, rows = store
    commit = snapshots.begin(spark, root)
    nulls = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0)], "project_id long, id long, total double")
    commit.append("lines", nulls)
    commit.rebucket("lines", rows_per_bucket=300)
    assert commit.finish() == 2 and snapshots.manifest(spark, root)[1]["lines"].buckets == 4 - (rows.count() + 2 <= 900)
    same(snapshots.read(spark, root, "lines", keys=[None]), nulls)
    same(snapshots.read(spark, root, "lines"), rows.union(nulls))
    commit = snapshots.begin(spark, root)
    commit.replace("lines", nulls.limit(0), rows.union(nulls).select("project_id"))
    commit.finish()
    assert snapshots.read(spark, root, "lines").count() == 0
    gone = snapshots.vacuum(spark, root, keep=1)
    assert any(g.startswith("data/") for g in gone) and snapshots.versions(spark, root) == [3]
    assert snapshots.read(spark, root, "lines").count() == 0


def test_replace_touch_and_version_in_one_commit(spark, tmp_path):
    root = f"file://{tmp_path}/bill"
    lines = spark.createDataFrame([(1, "Civil", 10.0), (1, "Paint", 5.0), (2, "Civil", 7.0)], "project_id long, trade string, total double")
    day = datetime(2024, 1, 1)
    projects = spark.createDataFrame([(1, "a", day), (2, "b", day), (3, "c", day)], "id long, name string, updated_at timestamp")
    create_store(spark, root, lines, projects)
    at = datetime(2024, 6, 1, tzinfo=UTC)
    new = lines.where("project_id = 1").withColumn("total", F.col("total") * 2)
    scope = spark.createDataFrame([(1,), (3,)], "project_id long")
    assert replace_lines(spark, root, new, scope, at) == 2
    assert replace_lines(spark, root, new.limit(1), scope, at) == 3
    got = {r["project_id"]: r["t"] for r in snapshots.read(spark, root, "lines", version=2).groupBy("project_id").agg(F.sum("total").alias("t")).collect()}
    assert got == {1: 30.0, 2: 7.0}
    moved = {r["id"]: r["updated_at"].month for r in snapshots.read(spark, root, "projects").collect()}
    assert moved == {1: 6, 2: 1, 3: 6}
    assert snapshots.read(spark, root, "versions").count() == 2 and snapshots.read(spark, root, "versions", version=2).count() == 1
