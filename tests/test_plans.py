"""Plan shape: what would not scale must not appear."""

import re

import pytest

from conftest import SMALL_DIR
from plan_inspect import formatted_plan, plan_problems, single_partition_parents
from usagelens.plans.registry import QUERIES
from usagelens.sources import fixture_sources

MOST_SHUFFLES = 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cartesian_no_global_window(spark, name):
    assert plan_problems(QUERIES[name](spark, SMALL_DIR)) == []


def test_checker_catches_single_task_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    base = spark.range(10).withColumn("x", F.col("id") % 3)
    assert plan_problems(base.withColumn("a", F.avg("id").over(Window.partitionBy()))) == ["unpartitioned window"]
    assert plan_problems(base.withColumn("a", F.sum("id").over(Window.orderBy("x")))) == ["unpartitioned window"]
    assert plan_problems(base.withColumn("a", F.sum("id").over(Window.partitionBy("x").orderBy("id")))) == []


def test_flagship_pushes_date_filter_and_prunes_columns(spark):
    plan = formatted_plan(QUERIES["enhanced_history"](spark, SMALL_DIR))
    assert "Window" not in plan  # whole-history averages are scalar subqueries, not OVER ()
    assert "GreaterThanOrEqual(ts,2024-01-16T00:00)" in plan  # day filter reaches both history scans
    assert plan.count("GreaterThanOrEqual(ts,2024-01-16T00:00)") >= 2
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan  # narrow cost scan


def test_overlap_join_is_binned_equi_join(spark):
    plan = formatted_plan(QUERIES["interval_overlap"](spark, SMALL_DIR))
    assert "_ovl_cell" in plan and "Generate" in plan
    assert "NestedLoop" not in plan


def test_cost_is_shuffled_once_on_statement_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = formatted_plan(QUERIES["enhanced_history"](spark, SMALL_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [l for l in plan.splitlines() if l.startswith("Arguments: hashpartitioning(workspace_id")]
    # one exchange for the wide statement rows, one for the cost pairs; the cost
    # aggregate and the final join reuse it
    assert len(exchanges) == 2


def test_latest_schedules_read_the_log_once_and_limit_groups(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = formatted_plan(QUERIES["latest_schedules"](spark, SMALL_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan.split("\n\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2 and "Join" not in tree.replace("BroadcastNestedLoopJoin", "Join").split("Union")[0].split("Scan")[0]
    log = formatted_plan(fixture_sources(spark, SMALL_DIR).audit_log.where("service_name = 'jobs' and action_name in ('create', 'update', 'delete')"))
    assert plan.count("Location: InMemoryFileIndex") == log.count("Location: InMemoryFileIndex")


def _log_scans(plan: str) -> int:
    return plan.count("Location: InMemoryFileIndex")


@pytest.mark.parametrize("name, shuffles", [("run_history", 1), ("run_stats", 4)])
def test_runs_read_the_log_once(spark, tmp_path, name, shuffles):
    from usagelens.operators import run_events, run_history, run_stats

    fixture_sources(spark, SMALL_DIR).audit_log.write.parquet(str(tmp_path / "log"))
    events = run_events(spark.read.parquet(str(tmp_path / "log")))
    plan = formatted_plan({"run_history": run_history, "run_stats": run_stats}[name](events))
    tree = plan.split("\n\n\n")[0]
    assert _log_scans(plan) == 1 and tree.count("Exchange") == shuffles and "Join" not in tree


def test_latest_schedules_scan_one_log_table_once(spark, tmp_path):
    from usagelens.operators import latest_schedules, schedule_changes

    fixture_sources(spark, SMALL_DIR).audit_log.write.parquet(str(tmp_path / "log"))
    plan = formatted_plan(latest_schedules(schedule_changes(spark.read.parquet(str(tmp_path / "log")))))
    assert _log_scans(plan) == 1 and plan.split("\n\n\n")[0].count("Exchange") == 2


def test_node_cost_report_shuffles(spark, tmp_path):
    """Sources as plain tables, nothing broadcast: what the cost needs, then one shuffle for both passes of the median."""
    from usagelens.plans import node_cost_report
    from usagelens.sources import from_parquet
    from usagelens.sources.tables import SOURCE_NAMES

    fx = fixture_sources(spark, SMALL_DIR)
    for n in SOURCE_NAMES:
        getattr(fx, n).write.parquet(str(tmp_path / n))
    report = node_cost_report(from_parquet(spark, str(tmp_path)), as_of="2024-01-31")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # shows reused exchanges before the run
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = formatted_plan(node_cost_report(from_parquet(spark, str(tmp_path)), as_of="2024-01-31"))
    finally:
        for k in conf:
            spark.conf.unset(k)
    tree = plan.split("\n\n\n")[0]
    assert len(re.findall(r"[^d]Exchange \(", tree)) <= MOST_SHUFFLES and "ReusedExchange" in tree
    assert plan.count("REPARTITION_BY_COL") == 2  # the cost pairs by statement, the report's rows by node and bucket
    report.collect()
    assert "ReusedExchange" in report._jdf.queryExecution().executedPlan().toString()


def test_stated_longest_usage_prunes_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from usagelens.operators import statement_cost

    src = fixture_sources(spark, SMALL_DIR)
    src.usage.write.partitionBy("usage_date").parquet(str(tmp_path / "usage"))
    usage = spark.read.parquet(str(tmp_path / "usage"))
    since = F.to_date(F.lit("2024-01-16"))
    cost = lambda hours, u=usage: statement_cost(src.query_history, u, src.list_prices, since=since, longest_usage_hours=hours)
    plan = formatted_plan(cost(1))
    assert "usage_date" in "".join(x for x in plan.splitlines() if "PartitionFilters" in x and "2024-01-14" in x)
    assert not [x for x in formatted_plan(cost(None)).splitlines() if "PartitionFilters" in x and "2024-01" in x]
    rounded = lambda df: df.withColumn("approx_query_cost", F.round("approx_query_cost", 9))
    stated, whole = rounded(cost(1)), rounded(cost(None))
    assert whole.count() > 0 and stated.exceptAll(whole).count() == 0 and whole.exceptAll(stated).count() == 0
    longer = usage.limit(1).select(*[F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias(c) if c == "usage_start_time" else c for c in usage.columns])
    longer = longer.withColumn("usage_end_time", F.lit("2024-01-22 00:00:00").cast("timestamp_ntz")).withColumn("usage_date", F.lit("2024-01-20").cast("date"))
    longer = longer.withColumn("sku_name", F.lit("PREMIUM_SERVERLESS_SQL_COMPUTE"))
    with pytest.raises(Exception, match="longer than the stated 1 hours"):
        cost(1, usage.unionByName(longer)).collect()


def test_latest_per_key_limits_groups_before_the_shuffle(spark):
    plan = formatted_plan(QUERIES["latest_per_key"](spark, SMALL_DIR)).split("\n\n\n")[0]
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Scan parquet") == 1


def test_run_totals_read_the_events_once(spark):
    from usagelens.operators import run_events, run_totals
    src = fixture_sources(spark, SMALL_DIR)
    narrow = run_events(src.audit_log)
    one = formatted_plan(run_totals(narrow)).count("Location: InMemoryFileIndex")
    assert one == formatted_plan(narrow.groupBy("job_id").count()).count("Location: InMemoryFileIndex")


def test_day_bound_reaches_the_usage_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from usagelens.operators import statement_cost
    src = fixture_sources(spark, SMALL_DIR)
    src.usage.write.parquet(str(tmp_path / "usage"))
    usage = spark.read.parquet(str(tmp_path / "usage"))
    plan = formatted_plan(statement_cost(src.query_history, usage, src.list_prices, since=F.to_date(F.lit("2024-01-16"))))
    assert "GreaterThan(usage_end_time,2024-01-16T00:00)" in plan


@pytest.mark.parametrize("name", ["enhanced_history", "fleet_averages", "node_cost_report"])
def test_single_partition_only_under_aggregates(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parents = single_partition_parents(QUERIES[name](spark, SMALL_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if name != "node_cost_report":  # the rollup does not output the averages: subquery pruned
        assert parents, "the fleet averages use a one-row aggregate"
    assert all(p in ("HashAggregate", "ObjectHashAggregate") for p in parents), parents


def test_single_partition_checker_sees_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("a", F.avg("id").over(Window.partitionBy()))
    assert "Window" in single_partition_parents(df)


def test_positions_equal_a_plain_sort(spark):
    import random

    from pyspark.sql import functions as F

    from usagelens.operators import with_position

    rng = random.Random(5)
    data = [(rng.choice([0.0, 0.0, rng.random(), None]), f"k{i}") for i in range(5000)]
    df = spark.createDataFrame(data, "v double, k string").repartition(7)
    order = [F.desc("v"), F.asc("k")]
    got = with_position(df, order)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    assert [tuple(r)[:2] for r in got.orderBy("position").collect()] == want
    assert [r.position for r in got.orderBy("position").collect()] == list(range(1, 5001))
    assert plan_problems(got) == [] and all(p in ("HashAggregate", "ObjectHashAggregate") for p in single_partition_parents(got))
    # zeros, half of the rows, lie in several ranges
    ranges = df.orderBy(*order).withColumn("p", F.spark_partition_id()).where("v = 0").select("p").distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranges.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert with_position(df.limit(0), order).count() == 0
