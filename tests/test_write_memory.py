"""Tasks that write partition folders stay small."""

from __future__ import annotations

import pytest

from tideway.sources import tables


@pytest.mark.parametrize("by, most", [((), 256), (("k",), 64)])
def test_sorted_writes_read_small_partitions(spark, tmp_path, monkeypatch, by, most):
    """Rows are sorted by folder before they are written, so what a task reads bounds its memory."""
    seen, even = [], tables._file_sized

    def spied(*args):
        out = even(*args)
        with even(*args):
            seen.append(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
        return out

    monkeypatch.setattr(tables, "_file_sized", spied)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    df = spark.range(100).selectExpr("id", "id % 3 as k")
    tables.write_table(df, str(tmp_path / "t"), by)
    assert len(seen) == 1 and int(seen[0].rstrip("m")) <= most
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert sorted(spark.read.parquet(str(tmp_path / "t")).select("id", "k").collect()) == sorted(df.collect())
