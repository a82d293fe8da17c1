"""Files of bursting terms: one JSON record ``{date, pairs}`` per slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TERM_JSON = "date bigint, pairs map<string,double>"


def pack_burst_terms(terms: DataFrame) -> DataFrame:
    """``(date, token, score)`` rows to one record per date, tokens in order."""
    return terms.groupBy("date").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "score")))).alias("pairs")
    )


def write_burst_terms(terms: DataFrame, path: str) -> None:
    """One JSON line per date.  A date's record holds its bursting terms only, never its posts."""
    pack_burst_terms(terms).write.json(path)


def read_burst_records(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(TERM_JSON).json(path).filter(F.col("date").isNotNull())


def last_record_wins(records: DataFrame, order: str = "line_no") -> DataFrame:
    """Of several records for a date the last one counts, as a whole."""
    return (
        records.groupBy("date")
        .agg(F.max_by("pairs", order).alias("pairs"))
        .select("date", F.explode("pairs").alias("token", "score"))
    )


def read_burst_terms(spark: SparkSession, path) -> DataFrame:
    """Records in long form ``(date, token, score)``; file order decides between equal dates."""
    records = read_burst_records(spark, path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return last_record_wins(records.select("date", "pairs", place.alias("line_no")))
