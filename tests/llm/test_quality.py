from brute import SMALL, same_rows
from pyspark.sql import functions as F

from usagelens.llm import oracles, quality
from usagelens.llm.queries import op1_quality_rules

SCHEMA = "doc_id long, text string, n_words string"


def test_whole_table_equals_sql(spark):
    assert same_rows(op1_quality_rules(spark, SMALL), oracles.QUALITY)


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b c a b c", "x"), (3, "a b c a b c", "x"),
        (4, "\n".join(["one two"] * 3 + ["", " "]), "x"), (5, "w " * 30_000, "x"), (6, "a b c d a b c e b c d", "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = quality.quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "kept").collect()
    got = sorted((tuple(r) for r in found), key=repr)
    assert got == sorted(
        [
            (1, 0, 0, 0, 0, False), (2, 0, 0, 0, 0, False), (None, 2, 2, 0, 0, False), (3, 6, 6, 0, 6, False), (3, 6, 6, 0, 6, False),
            (4, 6, 18, 2, 6, False), (5, 30_000, 30_000, 0, 30_000, False), (6, 11, 11, 0, 10, False),
        ],
        key=repr,
    )
    assert quality.quality_cascade(docs.limit(0)).count() == 0


def test_order_follows_rejections_per_cost_and_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = quality.default_rules()
    order = quality.order_rules(docs, rules)
    assert sorted(n for n, _, _ in order) == sorted(rules)
    rate = [-share / max(sec, 1e-3) for _, share, sec in order]
    assert rate == sorted(rate)
    first = quality.quality_cascade(docs, rules).where("kept").select("doc_id")
    other = quality.quality_cascade(docs, dict(reversed(rules.items())), sample_rows=10).where("kept").select("doc_id")
    assert sorted(first.collect()) == sorted(other.collect())


def test_clashing_columns_are_kept_or_replaced(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "y", "z", True)], "doc_id long, text string, by_word string, _by_word string, _by_line string, kept boolean")
    found = quality.quality_cascade(docs)
    assert found.columns == ["doc_id", "text", "by_word", "_by_word", "_by_line", *quality.BASE, "kept"]
    assert found.select("by_word", "_by_word", "_by_line", "n_words", "kept").first()[:] == ("x", "y", "z", 2, False)


def test_costly_measures_stand_behind_the_cheaper_rules(spark):
    """What only a rule reads is nowhere but in the verdict's conditions, after what failed the base."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = quality.quality_cascade(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    at = {name: plan.index(name) for name in ("\\p{L}", "AS kept")}
    assert plan.count("\\p{L}") == 1 and at["\\p{L}"] < at["AS kept"]
    verdict = plan[plan.rindex("CASE WHEN", 0, plan.index("THEN false")) : plan.index("AS kept")]
    assert "\\p{L}" in verdict and "\\p{L}" not in quality.measures(docs)._jdf.queryExecution().optimizedPlan().toString()
    # the rules' order is that of rejections per cost, as measured; a rule put first ends the work for what it rejects
    boom = F.raise_error(F.lit("evaluated")).cast("boolean")
    rules = {"all": F.col("n_words") >= 0, "never": boom}
    verdict = F.when(F.col("base_failed"), F.lit(False)).when(rules["all"], F.lit(False)).when(rules["never"], F.lit(False))
    assert quality.measures(docs).withColumn("kept", verdict.otherwise(True)).where("kept").count() == 0


def test_sample_is_by_hash_and_bounded(spark):
    docs = spark.range(20_000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(7)
    one, two = quality._sample(docs, 100), quality._sample(docs.repartition(3), 100)
    texts = sorted(r.text for r in one.collect())
    assert len(texts) == 100 and texts == sorted(r.text for r in two.collect())
    same = spark.range(5000).select(F.lit("one text").alias("text"))
    assert quality._sample(same, 100).count() == 100 and quality._sample(same.limit(0), 100).count() == 0
    assert quality._sample(same.withColumn("text", F.repeat("text", 20_000)), 100).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = quality.quality_cascade(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_labels_agree(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = quality.quality_cascade(spark.read.parquet(f"{SMALL}/documents.parquet")).join(labels, "doc_id")
    assert found.where("quality = 0 AND kept").count() == 0
    assert found.where((F.col("quality") == 1) & ~F.col("kept") & ~F.col("base_failed")).count() == 0
