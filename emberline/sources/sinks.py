"""Result shapes and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.timeslice import format_time, slot_start


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def write_parts(rows: DataFrame, path: str, by: str = "part") -> None:
    """Headerless CSV with one file per value of ``by``; a value that is written again replaces its own file."""
    writer = rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).csv(path, escape='"')


def selected_rows(selected: DataFrame, width: int, *keep: str) -> DataFrame:
    """``topic, epoch_s, id, text`` of selected posts (columns ``topic, win, post_id, text``)."""
    return selected.select(
        "topic", (F.col("win") * F.lit(width)).alias("epoch_s"), F.col("post_id").alias("id"), one_line(F.col("text")).alias("text"), *keep
    )


def write_selected(selected: DataFrame, path: str, width: int, mode: str = "error") -> None:
    """Headerless CSV; quotes inside a field are doubled."""
    selected_rows(selected, width).write.mode(mode).csv(path, escape='"')


def read_selected(spark, path) -> DataFrame:
    return spark.read.schema("topic string, epoch_s bigint, id bigint, text string").csv(path, escape='"')


def scored_term_rows(scores: DataFrame, width: int) -> DataFrame:
    """``time, token, score`` in order of time; the sort runs over range partitions."""
    return scores.orderBy("win", "token").select(
        format_time(slot_start(F.col("win"), width), "long").alias("time"), "token", "score"
    )


def write_scored_terms(scores: DataFrame, path: str, width: int) -> None:
    scored_term_rows(scores, width).write.csv(path, escape='"')


def window_stat_rows(stats: DataFrame, width: int) -> DataFrame:
    time = format_time(slot_start(F.col("win"), width), "long").alias("time")
    return stats.orderBy("win").select(time, "min", "max", "avg", "sigma")


def write_window_stats(stats: DataFrame, path: str, width: int) -> None:
    window_stat_rows(stats, width).write.csv(path)


def write_raw(lines: DataFrame, path: str) -> None:
    """Original lines, gzip-compressed."""
    lines.select("value").write.option("compression", "gzip").text(path)


def burst_log_rows(terms: DataFrame, width: int, *keep: str) -> DataFrame:
    """``topic, token, score, epoch_ms`` of bursting terms."""
    return terms.select("topic_id", "token", "score", (F.col("win") * F.lit(width * 1000)).alias("epoch_ms"), *keep)


def write_burst_log(terms: DataFrame, path: str, width: int) -> None:
    burst_log_rows(terms, width).write.mode("append").csv(path, escape='"')


def threshold_log_rows(changes: DataFrame, width: int, step: str = "win", *keep: str) -> DataFrame:
    """``topic, passing, old, new, epoch_ms`` of threshold changes; ``passing`` is the count that caused one."""
    passing = "bursts" if "bursts" in changes.columns else "posts"
    at = (F.col(step) * F.lit(width * 1000)).alias("epoch_ms")
    return changes.select("topic_id", F.col(passing).alias("passing"), "old_threshold", "new_threshold", at, *keep)


def write_threshold_log(changes: DataFrame, path: str, width: int, step: str = "win") -> None:
    """Lines of the burst log that tell of a threshold's change."""
    threshold_log_rows(changes, width, step).write.mode("append").csv(path, escape='"')


def delivery_payload(selected: DataFrame, base: str, client: str, *keep: str) -> DataFrame:
    """Target address and JSON body per delivered post (``topic_id, post_id, sim, hits``)."""
    body = F.struct(
        F.col("post_id").alias("id"),
        F.col("post_id").cast("string").alias("id_str"),
        F.col("sim").alias("jaccardSim"),
        F.col("hits").alias("tweetBurstCount"),
    )
    address = F.format_string("%s/tweet/%s/%s/%s", F.lit(base), F.col("topic_id"), F.col("post_id").cast("string"), F.lit(client))
    return selected.select("topic_id", "post_id", address.alias("address"), F.to_json(body).alias("body"), *keep)


def write_run(run: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated run file."""
    run.write.csv(path, sep="\t", header=header)
