from pyspark.sql import functions as F

from conftest import rows, ts
from usagelens.functions import (
    elapsed_seconds,
    epoch_seconds_between,
    first_block_comment,
    first_of,
    ms_to_seconds,
    seconds_or_zero,
    time_bin,
)


def test_first_block_comment_cases(spark):
    df = spark.createDataFrame(
        [(1, '/* {"app": "x"} */ select 1'), (2, "select 1"), (3, "select */ 1 /*"), (4, None), (5, "/**/")],
        "id int, t string",
    )
    out = dict(rows(df.select("id", first_block_comment("t").alias("c"))))
    assert out == {1: ' {"app": "x"} ', 2: "", 3: "", 4: None, 5: ""}


def test_elapsed_truncates_but_epoch_counts_boundaries(spark):
    df = spark.createDataFrame([(ts(2024, 1, 1, 0, 0, 0, 900000), ts(2024, 1, 1, 0, 0, 2, 100000))], "a timestamp_ntz, b timestamp_ntz")
    assert rows(df.select(elapsed_seconds("a", "b"), epoch_seconds_between("a", "b"))) == [(1, 2)]


def test_ms_helpers_never_raise(spark):
    df = spark.createDataFrame([(1500,), (None,), (0,)], "ms long")
    assert rows(df.select(ms_to_seconds("ms"), seconds_or_zero("ms"))) == sorted(
        [(1.5, 1.5), (None, 0.0), (0.0, 0.0)], key=repr
    )
    # division by a zero column gives NULL instead of an ANSI error
    assert df.select(F.try_divide(F.lit(1), F.col("ms") - F.col("ms"))).collect()[0][0] is None


def test_first_of_empty_or_missing_array_is_null(spark):
    df = spark.createDataFrame([([],), (None,), (["a", "b"],)], "a array<string>")
    assert rows(df.select(first_of(F.col("a")))) == sorted([(None,), (None,), ("a",)], key=repr)


def test_time_bin_is_monotone_and_session_zone_free(spark):
    df = spark.createDataFrame([(ts(2024, 1, 1, 0, 59, 59),), (ts(2024, 1, 1, 1, 0, 0),)], "t timestamp_ntz")
    before = rows(df.select(time_bin("t", 3600)))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        after = rows(df.select(time_bin("t", 3600)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after
    assert before[1][0] == before[0][0] + 1


def _comment_body_brute_force(t):
    """Plain-Python statement of the rule: instr positions are 1-based (0 when absent);
    substr from instr('/*') + 2 for instr('*/') - instr('/*') - 2 characters; '' when <= 0."""
    if t is None:
        return None
    o, c = t.find("/*") + 1, t.find("*/") + 1
    length = c - o - 2
    return "" if length <= 0 else t[o + 1 : o + 1 + length]


def test_first_block_comment_matches_brute_force(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.text(alphabet="/*a {}", max_size=14)), min_size=300, max_size=300))
    def check(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = dict(df.select("i", first_block_comment("t")).collect())
        assert got == {i: _comment_body_brute_force(t) for i, t in enumerate(texts)}

    check()


def test_map_parse_equals_json_path_extraction(spark):
    """Reading keys from one map parse gives what a per-key JSON path read gives."""
    from usagelens.functions import json_string_map

    cases = [
        '{"app": "dbt", "node_id": "m.x"}', ' {"app":"dbt"} ', '{"app": {"a": 1, "b": [1,2]}}', '{"app": [1, "x"]}',
        '{"app": 12.50}', '{"app": true}', '{"app": null}', '{"app": "a\\\\"b"}', '{"app": "caf\\\\u00e9"}',
        '{"app": "x", "app": "y"}', '{"app": "x"} trailing', "{'app': 'x'}", '{"app": "x",}', '[{"app": "x"}]', '',
        'not json', '{"node_id": "n", "other": {"app": "deep"}}', '{"app": ""}', '{"app":"x"}{"app":"y"}',
        '{"app": 1e3}', None,
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    for key in ["app", "node_id"]:
        diff = df.where(~F.get_json_object("t", f"$.{key}").eqNullSafe(json_string_map("t")[key]))
        assert diff.count() == 0


def test_union_task_schema_equals_separate_parses(spark):
    """Parsing the create-task payload once with the union of the three task shapes reads
    the same fields as three separate parses, malformed sub-objects included."""
    from usagelens.functions import first_of
    from usagelens.schemas import TASKS_DDL

    shape = "array<struct<task_key:string, sql_task:struct<{kind}:struct<{kind}_id:string, pause_subscriptions:boolean>, warehouse_id:string>>>"
    cases = [
        '[{"task_key": "t", "sql_task": {"alert": {"alert_id": "a1"}, "warehouse_id": "w"}}]',
        '[{"task_key": "t", "sql_task": {"dashboard": "oops", "alert": {"alert_id": "a1"}, "warehouse_id": "w"}}]',
        '[{"task_key": "t", "sql_task": {"alert": {"alert_id": 5}, "warehouse_id": "w"}}]',
        '[{"task_key": "t", "sql_task": {"alert": {"alert_id": "a1", "pause_subscriptions": "yes"}}}]',
        '[{"sql_task": {"dashboard": {"dashboard_id": "d1", "pause_subscriptions": "bad"}, "query": {"query_id": "q"}}}]',
        '[]', 'junk', None,
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    union = F.from_json("t", TASKS_DDL)
    for kind in ["alert", "dashboard", "query"]:
        alone = F.from_json("t", shape.format(kind=kind))
        for a, b in [
            (first_of(union["sql_task"][kind][f"{kind}_id"]), first_of(alone["sql_task"][kind][f"{kind}_id"])),
            (first_of(union["sql_task"]["warehouse_id"]), first_of(alone["sql_task"]["warehouse_id"])),
        ]:
            assert df.where(~a.eqNullSafe(b)).count() == 0
