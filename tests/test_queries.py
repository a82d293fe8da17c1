"""Registered queries against their SQL definitions on the smallest tables.

By default the quick ones run; EMBERLINE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "read_posts read_topics filter_lang keyword_match topic_match topic_score tokenize extract_entities bigrams jaccard "
    "clean_tokens topic_terms term_user_counts minor_window_merge slice_profile vocab_size top_hashtags top_terms "
    "window_stats topic_assign expand_topics topic_runs validate_run validate_run_daily stream_term_counts "
    "topic_match_many topic_rows model_join repost_escalation repost_escalation_long validate_run_caps read_keywords "
    "parse_topic_markup topic_corpus_filter"
).split()
NAMES = sorted(entry.queries()) if os.environ.get("EMBERLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_definition(spark, sql, name):
    frame = entry.queries()[name](spark, FOLDER)
    if name not in entry.oracle_sql():
        assert frame.count() > 0
        return
    result = sql.execute(entry.oracle_sql()[name])
    verdict = compare(frame, ([d[0] for d in result.description], result.fetchall()))
    assert verdict.startswith("ok"), verdict


def test_every_definition_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
