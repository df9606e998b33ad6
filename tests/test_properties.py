"""Properties on the smallest test tables and on a skewed input."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from conftest import SMALL_DIR
from usagelens.functions import elapsed_seconds, time_bin
from usagelens.operators import overlap as O
from usagelens.operators import (
    allocate_cost,
    latest_schedules,
    priced_usage,
    run_events,
    run_totals,
    schedule_changes,
    schedule_with_runs,
    statement_windows,
)
from usagelens.sources import fixture_sources


def test_overlap_seconds_never_exceed_statement_length(spark):
    src = fixture_sources(spark, SMALL_DIR)
    stmts = statement_windows(src.query_history)
    pairs = allocate_cost(stmts, priced_usage(src.usage, src.list_prices))
    pairs = pairs.dropDuplicates(["statement_id", "usage_start_time"])  # a SKU with two prices has each pair twice
    per_stmt = pairs.groupBy("statement_id", "start_time", "end_time").agg(
        F.sum("query_duration_in_interval").alias("charged"), F.count(F.lit(1)).alias("n")
    )
    bad = per_stmt.where(F.col("charged") > elapsed_seconds("start_time", "end_time"))
    assert per_stmt.count() > 0 and bad.count() == 0


def test_schedule_with_runs_keeps_latest_rows(spark):
    audit = fixture_sources(spark, SMALL_DIR).audit_log
    latest = latest_schedules(schedule_changes(audit))
    joined = schedule_with_runs(latest, run_totals(run_events(audit)))
    assert joined.count() == latest.count() > 0


def _cells(df):
    spans = O._spans(df, "s", "e", "_first", 3600)
    return O._into_cells(spans, "_first", O._LEFT, spans)


def test_hot_warehouse_is_spread_over_bins(spark):
    # one warehouse holds a third of the statements; binning spreads it over its hours
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        wh = "hot" if i % 3 == 0 else f"w{rng.randint(0, 50)}"
        start = base + dt.timedelta(seconds=rng.randint(0, 30 * 86400))
        rows.append((wh, i, start, start + dt.timedelta(seconds=rng.randint(1, 900))))
    df = spark.createDataFrame(rows, "warehouse_id string, id int, s timestamp_ntz, e timestamp_ntz")
    per_key = _cells(df).groupBy("warehouse_id", O.CELL).count()
    hot = per_key.where("warehouse_id = 'hot'")
    assert hot.count() > 300  # the hot warehouse becomes hundreds of join keys
    assert hot.agg(F.max("count")).first()[0] <= 20  # none of them large
    # the bin key is the hour index: a statement spans 1 + duration/bin keys
    spans = _cells(df).groupBy("id").count()
    assert spans.agg(F.max("count")).first()[0] <= 2
    assert df.select(time_bin("s", 3600)).distinct().count() > 500


def test_early_day_filter_on_cost_equals_late_filter(spark):
    from usagelens.functions import rolling_lower_bound
    from usagelens.operators import statement_cost

    src = fixture_sources(spark, SMALL_DIR)
    since = rolling_lower_bound("2024-01-31", 15)
    early = statement_cost(src.query_history, src.usage, src.list_prices, since=since)
    late = statement_cost(src.query_history, src.usage, src.list_prices).where(F.col("start_time") >= since)
    early, late = (d.withColumn("approx_query_cost", F.round("approx_query_cost", 9)) for d in (early, late))
    assert early.count() > 0
    assert early.exceptAll(late).count() == 0 and late.exceptAll(early).count() == 0


def test_flagship_binned_equals_plain(spark):
    from usagelens.plans import enhanced_history

    src = fixture_sources(spark, SMALL_DIR)
    cols = ["workspace_id", "statement_id", F.round("approx_query_cost", 9).alias("cost")]  # sum order may differ
    binned = enhanced_history(src, as_of="2024-01-31", sort=False).select(*cols)
    plain = enhanced_history(src, as_of="2024-01-31", bin_seconds=None, sort=False).select(*cols)
    assert binned.count() > 0
    assert binned.exceptAll(plain).count() == 0 and plain.exceptAll(binned).count() == 0


def test_overlong_spans_make_few_cells(spark):
    from usagelens.operators import interval_overlap

    rng = random.Random(3)
    base, far = dt.datetime(2024, 1, 1), dt.datetime(9999, 12, 31)
    at = lambda: base + dt.timedelta(seconds=rng.randint(0, 5 * 86400))
    long = lambda i: (at(), at() + dt.timedelta(hours=rng.choice([70, 500, 5000, 300_000, 400_000]) * rng.random()))
    left = [("w", i, at(), at()) for i in range(200)] + [("w", 300 + i, *long(i)) for i in range(40)]  # half of the first inverted
    left += [("w", 900, at(), far), ("w", 901, dt.datetime(1900, 1, 1), at()), ("w", 902, dt.datetime(9999, 1, 1), far), ("v", 903, at(), far)]
    right = [("w", h, base + dt.timedelta(hours=h), base + dt.timedelta(hours=h + 1)) for h in range(120)]
    right += [("w", 500, at(), far), ("w", 501, dt.datetime(1, 1, 2), base), ("v", 502, base, far)] + [("w", 600 + i, *long(i)) for i in range(20)]
    lhs = spark.createDataFrame(left, "k string, id int, s timestamp_ntz, e timestamp_ntz")
    rhs = spark.createDataFrame(right, "k string, h int, us timestamp_ntz, ue timestamp_ntz")
    for a, b in ((lhs, rhs), (lhs, rhs.where("h < 120")), (lhs.where("id < 200"), rhs)):
        binned = interval_overlap(a, b, "k", "s", "e", "us", "ue")
        plain = interval_overlap(a, b, "k", "s", "e", "us", "ue", bin_seconds=None)
        assert plain.count() > 1000 and binned.exceptAll(plain).count() == 0 and plain.exceptAll(binned).count() == 0
    # no row of either side stands in more cells than the levels allow, however far its end; none visits a level that the other side lacks
    l_spans, r_spans = O._spans(lhs, "s", "e", "first", 3600), O._spans(rhs, "us", "ue", "first", 3600)
    most = lambda spans, other, side, key: O._into_cells(spans, "first", side, other).groupBy(key).count().agg(F.max("count")).first()[0]
    assert most(l_spans, r_spans, O._LEFT, "id") <= 3 * (O.FACTOR + 2) and most(r_spans, l_spans, O._RIGHT, "h") <= 3 * (O.FACTOR + 2)
    hours, short = r_spans.where("h < 120"), l_spans.where("id < 200 and _ovl_level = 0")
    assert short.count() > 100 and most(short, hours, O._LEFT, "id") <= O.FACTOR + 1
    assert O._into_cells(hours, "first", O._RIGHT, short).count() == 240  # two bins for each hour


def test_hot_hour_of_the_overlap_is_split(spark):
    from usagelens.operators import interval_overlap

    base = dt.datetime(2024, 1, 1)
    lhs = spark.range(6000).selectExpr(
        "concat('w', if(id % 3 = 0, 0, id % 50)) AS k", "id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, if(id % 3 = 0, 1, id % 24), id % 50) AS s"
    ).withColumn("e", F.expr("s + interval 1 minute")).repartition(8)
    rhs = spark.createDataFrame([(f"w{w}", h, base + dt.timedelta(hours=h), base + dt.timedelta(hours=h + 1)) for w in range(50) for h in range(24)],
                                "k string, h int, us timestamp_ntz, ue timestamp_ntz").repartition(8)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = interval_overlap(lhs, rhs, "k", "s", "e", "us", "ue")
        assert len(df.collect()) >= 6000
        assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_median_equals_the_built_in_one(spark):
    from usagelens.operators.median import value_bucket, with_median

    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 5) if i % 3 else round(rng.gauss(0, 5))) for i in range(5000)] + [(None, float(i)) for i in range(4)]
    rows += [("one", 2.5), ("null", None), ("two", 1.0), ("two", 2.0), ("zero", 0.0), ("zero", -1e-300), ("zero", 1e300), ("some", None), ("some", 3.0)]
    rows += [("zeros", 0.0)] * 700 + [("zeros", 4.0)] * 5 + [("zeros", None)] * 300 + [("half", 0.0)] * 5 + [("half", 7.0)] * 5
    rows += [(f"k{i % 40}", rng.choice([rng.random(), 0.0, 1.0, 1.005])) for i in range(400)]
    df = spark.createDataFrame([(k, None if v is None else float(v), i) for i, (k, v) in enumerate(rows)], "k string, v double, i long").repartition(5)
    names = {"n_rows": "n", "n_values": "nv"}
    ours = with_median(df, ["k"], "v", "m", sums={"total": F.col("i")}, least={"first": F.col("i")}, **names)
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"), F.sum("i").alias("total"), F.min("i").alias("first"), F.median("v").alias("m"))
    assert ours.columns == plain.columns and ours.exceptAll(plain).count() == 0 and ours.count() == plain.count()
    # several keys, one of them NULL
    two = df.withColumn("j", F.when(F.col("i") % 3 > 0, F.col("i") % 3))
    ours = with_median(two, ["k", "j"], "v", "m", sums={}, least={}, **names)
    plain = two.groupBy("k", "j").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"), F.median("v").alias("m"))
    assert ours.exceptAll(plain).count() == 0 and ours.count() == plain.count()
    pairs = sorted(df.where("v IS NOT NULL").select("v", value_bucket(F.col("v"), F.col("i"))).collect())
    assert all(x[1] <= y[1] for x, y in zip(pairs, pairs[1:]) if x[0] < y[0])
    # a million distinct values of one key lie in many buckets, summed and sorted by several tasks
    million = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * 1.5).alias("v"))
    assert with_median(million, ["k"], "v", "m", sums={}, least={}, **names).first().m == 749_999.25
    assert million.select(value_bucket(F.col("v"))).distinct().count() > 500
    # a value that many rows share lies in buckets of its own
    assert spark.range(1000).select(value_bucket(F.lit(0.0), F.col("id"))).distinct().count() == 32
    assert with_median(df.limit(0), ["k"], "v", "m", sums={}, least={}, **names).count() == 0


def test_daily_sums_stand_in_for_history(spark):
    from usagelens.operators import daily_average_sums, statement_metrics, with_fleet_averages
    from usagelens.operators.metrics import AVERAGE_COLUMNS
    from usagelens.plans import enhanced_history

    src = fixture_sources(spark, SMALL_DIR)
    h = src.query_history
    h = h.unionByName(h.limit(3).withColumn("start_time", F.lit(None).cast("timestamp_ntz")))
    until = F.to_date(F.lit("2024-01-20"))
    near = lambda a, b: all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    for by in ([], ["warehouse_id"], ["workspace_id", "warehouse_id"]):
        daily = daily_average_sums(h, by)
        cols = ["statement_id", *AVERAGE_COLUMNS]
        whole = {r.statement_id: r[1:] for r in with_fleet_averages(statement_metrics(h), h, by).select(cols).collect()}
        parts = {r.statement_id: r[1:] for r in with_fleet_averages(statement_metrics(h), h, by, daily, until).select(cols).collect()}
        assert len(whole) > 50 and whole.keys() == parts.keys() and all(near(whole[k], parts[k]) for k in whole)
    with pytest.raises(ValueError):
        with_fleet_averages(h, h, daily=h)
    # the report: same rows, while the history is read since the given day only
    daily = daily_average_sums(src.query_history)
    cols = ["statement_id", *[F.round(c, 9).alias(c) for c in [*AVERAGE_COLUMNS, "approx_query_cost"]]]
    whole = enhanced_history(src, as_of="2024-01-31", sort=False).select(cols)
    parts = enhanced_history(src, as_of="2024-01-31", sort=False, daily=daily, daily_until="2024-01-16").select(cols)
    assert whole.count() > 0 and whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


