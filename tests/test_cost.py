import datetime as dt
import random

import pytest

from builders import history, prices, usage
from conftest import rows, ts
from usagelens.operators import interval_overlap, priced_usage, statement_cost

SKU = "PREMIUM_SERVERLESS_SQL_COMPUTE"
EPOCH = dt.datetime(1970, 1, 1)


def _usage_hour(h, qty, wh="w1", minutes=60):
    start = ts(2024, 1, 1, h)
    end = ts(2024, 1, 1, h, minutes - 1, 59) if minutes < 60 else ts(2024, 1, 1, h + 1)
    return {"usage_start_time": start, "usage_end_time": end, "usage_quantity": qty, "warehouse_id": wh}


def test_cost_rules(spark):
    h = history(
        spark,
        # 30 min inside hour 0 -> half of the hour's cost
        {"statement_id": "half", "start_time": ts(2024, 1, 1, 0, 0), "end_time": ts(2024, 1, 1, 0, 30)},
        # concurrent statement pays the full rate too (Q6)
        {"statement_id": "same", "start_time": ts(2024, 1, 1, 0, 0), "end_time": ts(2024, 1, 1, 0, 30)},
        # spans hours 0 and 1
        {"statement_id": "span", "start_time": ts(2024, 1, 1, 0, 30), "end_time": ts(2024, 1, 1, 1, 30)},
        # overlap under one second costs 0 but keeps a row (Q5)
        {"statement_id": "tiny", "start_time": ts(2024, 1, 1, 0, 59, 59, 500000), "end_time": ts(2024, 1, 1, 0, 59, 59, 900000)},
        # running statement never overlaps (Q4); statement with no usage disappears (Q3)
        {"statement_id": "running", "start_time": ts(2024, 1, 1, 0, 0), "end_time": None},
        {"statement_id": "nousage", "start_time": ts(2024, 1, 1, 5, 0), "end_time": ts(2024, 1, 1, 5, 10)},
    )
    u = usage(spark, _usage_hour(0, 2.0), _usage_hour(1, 4.0))
    p = prices(spark, (SKU, 0.5), ("PREMIUM_JOBS_COMPUTE", 9.0))
    out = dict(rows(statement_cost(h, u, p).select("statement_id", "approx_query_cost")))
    assert set(out) == {"half", "same", "span", "tiny"}
    assert out["half"] == pytest.approx(0.5)  # 2.0 qty * 0.5 price = 1.0 per hour
    assert out["same"] == pytest.approx(0.5)
    assert out["span"] == pytest.approx(0.5 + 1.0)
    assert out["tiny"] == 0.0


def test_price_rows_multiply_and_zero_length_interval_is_ignored(spark):
    h = history(spark, {"statement_id": "s", "start_time": ts(2024, 1, 1, 0, 0), "end_time": ts(2024, 1, 1, 2, 0)})
    zero = {"usage_start_time": ts(2024, 1, 1, 1), "usage_end_time": ts(2024, 1, 1, 1), "usage_quantity": 5.0, "warehouse_id": "w1"}
    u = usage(spark, _usage_hour(0, 1.0), zero)
    p = prices(spark, (SKU, 1.0), (SKU, 1.0))  # Q7: two price rows for one SKU
    out = dict(rows(statement_cost(h, u, p).select("statement_id", "approx_query_cost")))
    assert out["s"] == pytest.approx(2.0)  # Q21: zero-length interval has no rate


def test_priced_usage_sku_filter_is_case_insensitive(spark):
    u = usage(spark, {**_usage_hour(0, 1.0), "sku_name": "premium_serverless_SQL_x"}, {**_usage_hour(0, 1.0), "sku_name": "JOBS"})
    p = prices(spark, ("premium_serverless_SQL_x", 2.0), ("JOBS", 3.0))
    assert rows(priced_usage(u, p).select("sku_name", "total_cost_for_warehouse_uptime")) == [("premium_serverless_SQL_x", 2.0)]


def _random_intervals(rng, n, with_bad):
    out = []
    base = (ts(2024, 1, 1) - EPOCH).total_seconds()
    for i in range(n):
        s = base + rng.randint(0, 3 * 86400)
        length = rng.choice([0, 0.4, 1, 59, 3600, 5400, 7200 * rng.random(), 3 * 86400 * rng.random()])
        e = s + length
        if with_bad and rng.random() < 0.08:
            s, e = e, s  # inverted interval
        if with_bad and rng.random() < 0.05:
            e = None
        f = lambda x: None if x is None else EPOCH + dt.timedelta(seconds=x)
        out.append((f"k{rng.randint(0, 3)}", i, f(s), f(e)))
    return out


@pytest.mark.parametrize("bin_seconds", [3600, 600, 86400])
def test_binned_overlap_equals_plain_join(spark, bin_seconds):
    rng = random.Random(bin_seconds)
    left = spark.createDataFrame(_random_intervals(rng, 600, True), "k string, lid int, ls timestamp_ntz, le timestamp_ntz")
    right = spark.createDataFrame(_random_intervals(rng, 200, True), "k string, rid int, rs timestamp_ntz, re timestamp_ntz")
    binned = interval_overlap(left, right, "k", "ls", "le", "rs", "re", bin_seconds).select("lid", "rid")
    plain = interval_overlap(left, right, "k", "ls", "le", "rs", "re", None).select("lid", "rid")
    assert plain.count() > 100
    assert binned.exceptAll(plain).count() == 0 and plain.exceptAll(binned).count() == 0


def test_overlap_with_mixed_timestamp_types(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        left = spark.createDataFrame([("k", 1, ts(2024, 1, 1, 10, 10), ts(2024, 1, 1, 10, 50))],
                                     "k string, lid int, ls timestamp_ntz, le timestamp_ntz")
        right = spark.createDataFrame([("k", 2, ts(2024, 1, 1, 10, 0), ts(2024, 1, 1, 11, 0))],
                                      "k string, rid int, rs timestamp_ntz, re timestamp_ntz")
        right = right.withColumn("rs", right.rs.cast("timestamp")).withColumn("re", right.re.cast("timestamp"))
        plain = interval_overlap(left, right, "k", "ls", "le", "rs", "re", None).count()
        binned = interval_overlap(left, right, "k", "ls", "le", "rs", "re", 3600).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert plain == binned == 1
