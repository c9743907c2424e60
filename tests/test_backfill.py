"""Backfill runs against a plain loop, with a run that stops in the middle."""

import pytest
from pyspark.sql import functions as F

from fathomline.streaming.backfill import Backfill, listed

SIZES = {"1001": 0, "1002": 20, "1003": 59, "1004": 95, "7": 3}


def test_runs_go_on_where_they_ended(spark, tmp_path):
    held, met, sizes = Backfill(spark, str(tmp_path / "c")), [], dict(SIZES)
    fetch = lambda code, page: [{"ann_id": f"{code}-{i}", "title": f"t{i}", "date": "d"} for i in range((page - 1) * 20, min(page * 20, sizes.get(code, 0)))]
    codes = spark.createDataFrame([("Acme Bhd", "1001", 1), ("Beta Plc", "1002", 2), ("Gamma", "1003", 3), ("Delta", "1004", 4), ("Delta Berhad", " 1004 ", 5), ("Blank", " ", 6)], "name string, code string, pos int")
    asked = spark.createDataFrame([(x,) for x in ("ACME", "beta berhad", "gamma", "delta", "Delta Bhd", "7", "nobody", "blank", None)], "query string")
    handle = lambda df: met.append(sorted((r["company_code"], r["position"]) for r in df.collect()))
    cursor, want = {c: (0, False) for c in SIZES}, []

    def plain():
        rows = []
        for code, n in SIZES.items():
            offset, done = cursor[code]
            if done:
                rows += [(code, i) for i in range(min(n, 20))]
                continue
            last = (offset // 20 + 2) * 20
            rows += [(code, i) for i in range(offset, min(last, n))]
            cursor[code] = (0, True) if n < last else (last, False)
        want.append(sorted(rows))
        return len(rows)

    assert held.run(asked, codes, fetch, handle, "1") == plain()
    before = {r["company_code"]: r["next_offset"] for r in held.cursors.read().collect()}

    def stops(df):
        raise InterruptedError

    with pytest.raises(InterruptedError):
        held.run(asked, codes, fetch, stops, "2")
    assert {r["company_code"]: r["next_offset"] for r in held.cursors.read().collect()} == before
    for now in "234":
        assert held.run(asked, codes, fetch, handle, now) == plain()
    assert met == want
    assert {r["company_code"]: (r["next_offset"], r["done"]) for r in held.cursors.read().collect()} == cursor
    assert held.run(asked.filter("query = 'gamma'"), codes, fetch, handle, "9") == 20
    assert {r["company_code"]: r["updated_at"] for r in held.cursors.read().filter(F.col("updated_at") == "9").collect()} == {"1003": "9"}
    assert held.run(asked.limit(0), codes, fetch, handle, "x") == 0


def test_codes_are_dealt_to_all_tasks(spark):
    """few bytes of codes stand for many pages, so they are not put together into one task."""
    codes = spark.range(400).select(F.concat(F.lit("c"), "id").alias("company_code"), F.lit(5).alias("next_offset"), F.lit(False).alias("done"))
    fetch = lambda code, page: [{"ann_id": f"{code}-{page}-{i}", "title": "t", "date": None} for i in range(20 if page == 1 else 3)]
    rows = listed(codes, fetch)
    by_task = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in by_task) == 400 * 19
    mine = [tuple(r) for r in rows.filter("company_code = 'c7'").select("position", "ann_id", "ended").orderBy(F.col("position").asc_nulls_last()).collect()]
    assert mine == [(i, f"c7-1-{i}", None) for i in range(5, 20)] + [(20 + i, f"c7-2-{i}", None) for i in range(3)] + [(None, None, True)]
