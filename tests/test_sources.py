import json

from pyspark.sql import functions as F

from emberline.conf import load_properties
from emberline.functions.text import post_tokens, with_bigrams
from emberline.sources import posts as IN, sinks, terms as TERMS, topics as TOPICS


def record(**changes):
    base = {
        "id": 1,
        "text": "Stay safe #covid19 now",
        "lang": "en",
        "created_at": "Wed Jul 22 10:05:59 +0000 2015",
        "user": {"id": 7},
        "entities": {"hashtags": [{"text": "covid"}], "user_mentions": [], "urls": [], "media": []},
    }
    return json.dumps(base | changes)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_bad_lines_and_notices_are_dropped(spark):
    frame = lines(spark, record(), "{bad", json.dumps({"delete": {"status": {"id": 3}}}), "")
    row = IN.parse_posts(frame).collect()
    assert [r.post_id for r in row] == [1]
    assert row[0].created_at.isoformat() == "2015-07-22T10:05:59"
    assert row[0].is_repost is False and row[0].user_id == 7


def test_records_survive_a_round_trip(spark):
    first = IN.parse_posts(lines(spark, record(text='a "b", c\n\td', retweeted_status={"id": 5, "retweet_count": 100})))
    again = IN.parse_posts(IN.post_lines(first))
    columns = [c for c in first.columns if c not in ("lon", "lat")]
    assert first.select(columns).collect() == again.select(columns).collect()


def test_entities_come_first_and_are_cut_literally(spark):
    entities = {
        "hashtags": [{"text": "covid"}],
        "user_mentions": [{"screen_name": "who"}],
        "urls": [{"url": "http://t.co/x", "expanded_url": "http://example.org/long"}],
        "media": [],
    }
    frame = IN.parse_posts(lines(spark, record(text="#covid and #covid19: @who\tsays http://t.co/x it's", entities=entities)))
    tokens = frame.select(post_tokens("plain").alias("t")).first().t
    assert tokens == ["#covid", "@who", "http://example.org/long", "and", "19", "says", "it", "s"]
    assert frame.select(post_tokens("summary").alias("t")).first().t[-1] == "covid"
    assert frame.select(post_tokens("learner").alias("t")).first().t[-1] == "#covid"


def test_bigrams_need_two_tokens(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    out = [r[0] for r in frame.select(with_bigrams(F.col("t"))).collect()]
    assert out == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_properties(tmp_path):
    path = tmp_path / "p.properties"
    path.write_text("# c\nMAJOR_WINDOW_SIZE = 24\nBURST_THRESHOLD=0.07\nUSE_BIGRAMS = True\nOTHER = 1\n")
    conf = load_properties(str(path))
    assert (conf.major, conf.burst_threshold, conf.use_bigrams, conf.minor) == (24, 0.07, True, 1)


def test_topics_of_all_shapes(spark, tmp_path):
    shapes = [
        [{"query": "a OR b", "topid": "1", "description": "", "narrative": "n"}],
        [{"query": "c", "num": "2", "tokens": ["c"]}],
        [{"title": "d", "num": "3", "tokens": ["d", "e"]}],
    ]
    for i, shape in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text(json.dumps(shape, indent=1))
    rows = sorted(TOPICS.read_topics(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in rows] == [("1", "a OR b", []), ("2", "c", ["c"]), ("3", "d", ["d", "e"])]


def test_last_record_of_a_date_wins(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"date": 1, "pairs": {"a": 1.0, "b": 2.0}}\n{"date": 1, "pairs": {"a": 3.0}}\n')
    assert [tuple(r) for r in TERMS.read_burst_terms(spark, str(tmp_path)).collect()] == [(1, "a", 3.0)]


def test_selected_file_keeps_quotes_and_drops_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([("T", 10, 5, 'say "hi",\nyou')], "topic string, win bigint, post_id bigint, text string")
    sinks.write_selected(rows, str(tmp_path / "out"), 60)
    assert [tuple(r) for r in sinks.read_selected(spark, str(tmp_path / "out")).collect()] == [("T", 600, 5, 'say "hi", you')]


def test_topic_markup(spark):
    text = "<top>\n<num> Number: MB1\n<title> cats\n<desc> Description:\nall about cats\n\n</top>\n<top><num> Number: MB2 <title> x</top>"
    rows = TOPICS.parse_topic_markup(lines(spark, text)).select("num", "title", "desc").collect()
    assert [tuple(r) for r in rows] == [("MB1", "cats", "all about cats"), ("MB2", "x", "")]
