import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from loanscope.sources import named, tables


def test_replace_switches_whole_tables(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        named.read(spark, folder)
    named.replace(spark.range(5), folder)
    old = named.read(spark, folder)
    named.replace(spark.range(7).withColumn("p", F.col("id") % 2), folder, ["p"], "s1")
    assert named.read(spark, folder).count() == 7 and named.versions(spark, folder)[-1].state == "s1"
    assert old.count() == 5  # who has begun to read it can go on
    named.replace(spark.range(2), folder)
    assert len(named.vacuum(spark, folder, keep=2)) == 1 and [v.number for v in named.versions(spark, folder)] == [2, 3]
    assert named.vacuum(spark, folder, keep=1) and named.read(spark, folder).count() == 2


def test_a_failed_rebuild_leaves_the_old_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    named.replace(spark.range(3), folder)
    bad = spark.range(100).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        named.replace(bad, folder)
    assert named.read(spark, folder).count() == 3
    os.makedirs(f"{folder}/v-half")  # as a killed writer leaves it
    assert named.read(spark, folder).count() == 3 and "v-half" in named.vacuum(spark, folder)


def test_two_rebuilds_at_once_leave_one_whole_table(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    folder = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: named.replace(spark.range(n), folder), (11, 12, 13, 14)))
    assert named.read(spark, folder).count() in (11, 12, 13, 14)


def test_the_next_application_reads_the_first_ones_loans(spark, tmp_path, monkeypatch):
    src = tmp_path / "sf"
    shutil.copytree(SF001, src, ignore=shutil.ignore_patterns("documents*", "pages*", "conversations*", "embeddings*"))
    for p in [src, *src.iterdir()]:
        os.chmod(p, 0o755)
    spark.conf.set(tables.SHARED, str(tmp_path / "tables"))
    try:
        n = tables.scored_loans(spark, str(src)).count()
        built = {f.name: os.listdir(f) for f in (tmp_path / "tables").iterdir()}
        assert len(built) == 2
        # Another application knows nothing of what this one has built.
        monkeypatch.setattr(tables, "_MATERIALISED", {})
        monkeypatch.setattr(tables, "build_clean", None)
        other = spark.newSession()
        other.conf.set(tables.SHARED, str(tmp_path / "tables"))
        assert tables.scored_loans(other, str(src)).count() == n
        assert {f.name: os.listdir(f) for f in (tmp_path / "tables").iterdir()} == built
        monkeypatch.undo()
        # New input, new version of the same name.
        os.utime(src / "lineitem.parquet", (1, 1))
        assert tables.scored_loans(spark, str(src)).count() == n
        now = {f.name: os.listdir(f) for f in (tmp_path / "tables").iterdir()}
        assert set(now) == set(built) and all(len(now[k]) == len(built[k]) + 1 for k in now)
    finally:
        spark.conf.unset(tables.SHARED)
