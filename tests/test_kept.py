"""What several branches of a query read is computed once, so that plans stay short."""

import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from inciflow.operators import score as S
from inciflow.operators.ranking import rank_in_group
from inciflow.sources import bindings as B
from inciflow.sources.tables import CLEANUP, kept
from tests.conftest import SF


def test_kept_rows_are_read_back(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", None]), (1, ["a", None]), (None, None)], "k long, v array<string>")
    got = kept(df, "test")
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    # an empty table has its columns
    assert kept(df.limit(0), "test").columns == df.columns


def test_plans_of_scores_are_short(spark):
    """The names, profiles and lines of d11 and f18 stood in each of their branches: 87 exchanges in a plan."""
    for name in ("d11_score_all", "f18_recommend"):
        text = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") < 20, name


def test_messages_read_lines_scored_once(spark):
    text = entry.queries()["f11_top_messages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in text and "levenshtein" not in text


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    """They stayed until the driver collected its garbage, so a job's disk held those of all its steps."""
    files = lambda: sum("shuffle" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before, settings = files(), spark.conf.get(CLEANUP)
    kept(spark.range(1000).repartition(3, "id"), "test")
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(CLEANUP) == settings


def test_recommendations_of_busy_signatures(spark, con, monkeypatch):
    """Parts of a signature, packs of a list and tasks of a few lines give the same recommendations."""
    for k, v in (("PACK", 2), ("PART", 7), ("TASK", 900)):
        monkeypatch.setattr(S, k, v)
    ok, said = compare(spark, con, SF, "f18_recommend")
    assert ok, said


def test_long_lists_read_stored_offsets(spark):
    """What lies ahead of a cell was shuffled beside the rows that it ranks."""
    text = B.long_formula_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 1
    df = spark.createDataFrame([(g, a, i) for i, (g, a) in enumerate([(1, 2), (1, None), (None, 1), (1, 2), (None, None), (None, 1), (2, 7)])], "g int, a int, id int")
    ranked = [rank_in_group(df, ["g"], ["a"], [F.col("id")], "r", store=s).select("g", "a", "id", "r") for s in (True, False)]
    assert sorted(map(str, ranked[0].collect())) == sorted(map(str, ranked[1].collect())) and ranked[0].where("r = 2 AND g = 1 AND id = 3").count() == 1
