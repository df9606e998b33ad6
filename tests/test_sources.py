"""Loaders (catalog names, Parquet folders), lazy sources, and SQL access through views."""

import pytest

from conftest import SMALL_DIR
from usagelens.operators import statement_cost
from usagelens.operators.runs import run_events, run_history
from usagelens.plans import build_reports, build_views, register_views
from usagelens.sources import Sources, fixture_sources, from_catalog, from_parquet
from usagelens.sources.tables import SOURCE_NAMES


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_from_catalog_reads_named_tables(spark):
    fx = fixture_sources(spark, SMALL_DIR)
    names = {}
    for n in SOURCE_NAMES:
        getattr(fx, n).createOrReplaceTempView(f"t_{n}")
        names[n] = f"t_{n}"
    cat = from_catalog(spark, names)
    assert _same(
        statement_cost(cat.query_history, cat.usage, cat.list_prices),
        statement_cost(fx.query_history, fx.usage, fx.list_prices),
    )
    with pytest.raises(ValueError):
        from_catalog(spark, {"usage": "t_usage"})


def test_from_parquet_round_trip(spark, tmp_path):
    fx = fixture_sources(spark, SMALL_DIR)
    for n in SOURCE_NAMES:
        getattr(fx, n).write.parquet(str(tmp_path / n))
    pq = from_parquet(spark, str(tmp_path))
    assert _same(run_history(run_events(pq.audit_log)).drop("request_params", "response"),
                 run_history(run_events(fx.audit_log)).drop("request_params", "response"))


def test_sources_are_built_on_first_use_only(spark):
    built = []

    def make(name):
        def f():
            built.append(name)
            return spark.range(1)
        return f

    src = Sources(**{n: make(n) for n in SOURCE_NAMES})
    src.usage
    src.usage
    assert built == ["usage"]
    with pytest.raises(ValueError):
        Sources(usage=spark.range(1))


def test_registered_views_answer_sql(spark):
    views = build_views(fixture_sources(spark, SMALL_DIR), as_of="2024-01-31")
    names = register_views(spark, views, {"run_history": "rh_view"})
    assert names["run_history"] == "rh_view" and names["schedule_latest"] == "schedule_latest"
    n = spark.sql("SELECT count(*) FROM rh_view WHERE run_state = 'runSucceeded'").first()[0]
    assert n == views["run_history"].where("run_state = 'runSucceeded'").count() > 0
    top = spark.sql("SELECT approx_query_cost FROM enhanced_query_history ORDER BY approx_query_cost DESC LIMIT 1").first()[0]
    assert top == views["enhanced_query_history"].agg({"approx_query_cost": "max"}).first()[0]


def test_registered_reports_answer_sql(spark):
    reports = build_reports(fixture_sources(spark, SMALL_DIR), as_of="2024-01-31")
    register_views(spark, reports)
    n = spark.sql("SELECT count(*) FROM schedule_with_runs WHERE total_num_runs > 0").first()[0]
    assert n == reports["schedule_with_runs"].where("total_num_runs > 0").count() > 0
    first = spark.sql("SELECT total_run_duration_seconds FROM run_stats LIMIT 1").first()[0]
    assert first == reports["run_stats"].agg({"total_run_duration_seconds": "max"}).first()[0]


def test_saved_views_are_read_from_another_session(spark, tmp_path):
    from usagelens.plans import save_views

    views = build_views(fixture_sources(spark, SMALL_DIR), as_of="2024-01-31")
    frame = {"run_history": views["run_history"].drop("request_params", "response")}
    with pytest.raises(ValueError, match="temporary view"):
        register_views(spark, frame, {"run_history": "reports.runs"})
    with pytest.raises(ValueError, match="no name"):
        save_views(frame, {})
    spark.sql(f"CREATE DATABASE IF NOT EXISTS reports LOCATION '{tmp_path}/reports.db'")
    try:
        for name in ("reports.runs", "spark_catalog.reports.runs"):
            assert save_views(frame, {"run_history": name}) == {"run_history": name}
            assert spark.newSession().table(name).count() == frame["run_history"].count() > 0
    finally:
        spark.sql("DROP DATABASE reports CASCADE")


def test_catalog_views_outlive_the_session_and_see_new_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from usagelens.operators import daily_average_sums  # noqa: F401
    from usagelens.plans import create_views

    fx = fixture_sources(spark, SMALL_DIR)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS views LOCATION '{tmp_path}/views.db'")
    try:
        tables = {}
        for n in ("query_history", "usage", "list_prices", "audit_log"):
            tables[n] = f"views.{n}"
            getattr(fx, n).write.saveAsTable(tables[n])
        names = create_views(spark, tables, {v: f"spark_catalog.views.{v}" for v in build_views(fx)}, as_of="2024-01-31")
        assert names == {v: f"spark_catalog.views.{v}" for v in build_views(fx)}
        other = spark.newSession()
        texts = {c: F.to_json(c) for c in ("request_params", "response", "compute", "schedule_info", "update_info", "user_identity", "parsed_dbt_comment")}
        near = {c: F.round(c, 9) for c in ("approx_query_cost", "WarehouseAvgQueryRuntime", "WarehouseAvgQueueTime", "WarehouseAvgProportionTimeQueueing")}

        def flat(df):
            return df.select([(texts | near)[c].alias(c) if c in texts | near else c for c in df.columns])

        for logical, frame in build_views(fx, as_of="2024-01-31").items():
            saved = other.table(names[logical])
            assert saved.columns == frame.columns, logical
            assert saved.count() > 0 and saved.collect() is not None
            here = flat(spark.table(names[logical]))
            assert _same(here, flat(frame)), logical
        # a row that a source gets later is seen through the views that exist already
        before = {v: other.table(n).count() for v, n in names.items()}
        trigger = spark.table(tables["audit_log"]).where("action_name = 'runTriggered'").limit(1).collect()
        spark.createDataFrame(trigger, fx.audit_log.schema).write.insertInto(tables["audit_log"])
        after = {v: spark.newSession().table(n).count() for v, n in names.items()}
        assert after["run_history"] > before["run_history"] and after["schedule_history"] == before["schedule_history"]
        # only views whose tables are named are made
        assert set(create_views(spark, {"audit_log": tables["audit_log"]}, {v: f"views.{v}_2" for v in names})) == {"schedule_history", "schedule_latest", "run_history"}
    finally:
        spark.sql("DROP DATABASE views CASCADE")


def test_loaders_name_missing_and_wrong_columns(spark):
    fx = fixture_sources(spark, SMALL_DIR)
    names = {n: f"c_{n}" for n in SOURCE_NAMES}
    fx.usage.drop("usage_date").withColumn("sku_name", fx.usage["usage_quantity"]).createOrReplaceTempView("c_usage")
    fx.query_history.withColumn("more", fx.query_history["start_time"]).createOrReplaceTempView("c_query_history")
    src = from_catalog(spark, names)
    assert "more" in src.query_history.columns
    with pytest.raises(ValueError, match=r"source usage lacks: .*sku_name \(double, needed string\); usage_date \(missing|usage_date \(missing.*sku_name"):
        src.usage
