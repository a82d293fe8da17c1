"""Links inside large groups that are not links with the group's smallest member."""

import pytest
from pyspark.sql import functions as F

from emberline.llm import nearcopies


@pytest.mark.parametrize("dense", [8192, 4])
def test_no_link_of_a_crowded_variant_is_lost(spark, monkeypatch, dense):
    """Two groups of near copies whose fingerprints are all alike: the smallest member is of one of them only."""
    texts = [" ".join(f"{kind}{i}" for i in range(80)) + f" {kind}end{n}" for kind in "ab" for n in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    alike = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").cast("int")).alias("low")
    prints = docs.select("doc_id", nearcopies.text_key().alias("text_key"), alike, F.lit(0).cast("bigint").alias("high"))
    monkeypatch.setattr(nearcopies, "fingerprints", lambda docs, width: prints)
    monkeypatch.setattr(nearcopies, "MANY", 0)
    monkeypatch.setattr(nearcopies, "DENSE", dense)
    found = sorted((r.doc_id, r.component.doc_id) for r in nearcopies.groups(docs).collect())
    assert found == [(i, 0 if i < 6 else 6) for i in range(12)]


def test_pairs_of_a_crowded_variant_are_not_rows(spark):
    """One variant with dissimilar texts and a group of near copies: what comes out are the links that join the group."""
    texts = [f"copy{n} " + " ".join(f"a{i}" for i in range(80)) for n in range(30)] + [" ".join(f"t{n}w{i}" for i in range(80)) for n in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    near = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("node").cast("int")).alias("low")
    prints = docs.select("node", near, F.lit(0).cast("bigint").alias("high"), F.col("node").alias("label"))
    labelled = prints.join(nearcopies.shingle_sets(docs, 5), "node")
    links = {tuple(r) for r in nearcopies.remaining(labelled, 0.8).collect()}
    joined = {0}
    for _ in texts:
        joined |= {n for pair in links if joined & set(pair) for n in pair}
    assert joined == set(range(30)) and {n for pair in links for n in pair} == joined
    assert len(links) <= 2 * 30  # 435 pairs of the group, 1 770 in all
