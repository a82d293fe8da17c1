"""Properties of the physical plans that decide how the operators scale."""

import re

import pytest
from pyspark.sql import functions as F

from emberline.operators import matching as M, scores as S, select as L
from emberline.plans import queries as Q
from emberline.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange .*", plan)


@pytest.fixture(scope="module")
def cells(spark):
    rows = spark.range(2000).select((F.col("id") % 50).alias("slot"), F.concat(F.lit("t"), F.col("id") % 97).alias("token"))
    return Q.stage(rows.groupBy("slot", "token").agg(F.count("*").alias("n")), "cells")


def test_scores_shuffle_counts_once(cells):
    plan = plan_of(S.burst_scores(cells, 0, 49, 24))
    assert len(shuffles(plan)) == 1
    assert plan.count("BroadcastHashJoin") == 2


def test_top_rows_are_cut_before_the_shuffle(cells):
    plan = plan_of(L.top_per_group(cells, ["slot"], [F.desc("n"), F.col("token")], 5))
    assert "WindowGroupLimit" in plan
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_topic_queries_do_not_shuffle_text(spark):
    docs = table(spark, FOLDER, "documents").select(F.col("doc_id").alias("post_id"), "text", F.array().cast("array<string>").alias("hashtags"))
    plan = plan_of(M.topic_match(docs, Q.topics(spark)))
    assert not shuffles(plan)
    assert "source" not in plan.split("ReadSchema")[1]


def test_language_filter_reaches_the_scan(spark):
    docs = table(spark, FOLDER, "documents").filter(F.col("lang") == "en").select("doc_id")
    plan = plan_of(docs)
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]
