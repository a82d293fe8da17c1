"""Near copies of the pipeline: links against all pairs, recall, odd rows and large groups."""

import random

import pytest

from brute import alike, shingle_set
from emberline.llm import nearcopies, simhash


def copies(seed, originals, each, words=120, changes=2):
    draw = random.Random(seed)
    texts = []
    for _ in range(originals):
        own = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(words)]
        texts.append(" ".join(own))
        for _ in range(each):
            changed = list(own)
            for place in draw.sample(range(words), changes):
                changed[place] = "".join(draw.choices("xyz", k=6))
            texts.append(" ".join(changed))
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_groups_equal_all_pairs(table):
    rows = copies(1, 40, 2) + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (1004, "a b c")]
    found = {r.doc_id: r.component.doc_id for r in nearcopies.groups(table(rows)).collect()}
    sets = [(d, shingle_set(t, 5)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if alike(x, y) >= 0.8]
    assert len(links) >= 80
    assert sum(found[a] == found[b] for a, b in links) >= 0.95 * len(links)
    label = {d: d for d, _ in rows}
    for _ in range(5):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert all(label[found[d]] == label[d] for d in found)  # nothing else is linked


def test_recall_of_planted_copies(table):
    rows = copies(2, 300, 1, changes=2)  # similarities from 0.83
    kept = {r.doc_id for r in nearcopies.deduplicate(table(rows)).collect()}
    assert 300 <= len(kept) <= 300 + 0.1 * 300


@pytest.mark.parametrize("dense,many", [(8192, 16), (16, 1)])
def test_one_large_group(table, monkeypatch, dense, many):
    monkeypatch.setattr(nearcopies, "DENSE", dense)
    monkeypatch.setattr(nearcopies, "MANY", many)
    rows = copies(3, 1, 400, changes=1) + [(5000 + i, f"other text number {i} of its own with words {i * 7} and {i * 11} more") for i in range(60)]
    kept = {r.doc_id for r in nearcopies.deduplicate(table(rows)).collect()}
    assert 0 in kept and len(kept & set(range(401))) <= 8 and kept >= set(range(5000, 5060))


def test_rows_and_columns_stay(spark, table, odd, empty):
    frame = table(odd + [(21, "a b c"), (21, "a b c")])
    out = nearcopies.deduplicate(frame)
    assert out.columns == frame.columns and out.count() == len({r.doc_id for r in out.collect()})
    kept = {r.doc_id for r in out.collect()}
    assert 0 in kept and not kept & {1, 2, 8, 21, 12} and {3, 5, 7, 14} <= kept
    assert nearcopies.deduplicate(empty).count() == 0


def test_plain_documents(table, documents):
    found = {r.doc_id: r.component.doc_id for r in nearcopies.groups(table(documents)).collect()}
    sets = [(d, shingle_set(t, 5)) for d, t in documents]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and alike(x, y) >= 0.8]
    assert sum(found[a] == found[b] for a, b in links) >= 0.95 * len(links)


def test_simhash_links_across_the_sign(spark):
    """Fingerprints are signed numbers; their first bit counts like any other."""
    bases = [(0x0123456789ABCDEF * (2 * k + 1)) & ((1 << 62) - 1) for k in range(20)]
    pairs = [(x, (x ^ (1 << 63) ^ (1 << 3 * k)) - (1 << 64)) for k, x in enumerate(bases)]
    found = {frozenset(r) for r in simhash.links(spark.createDataFrame([(x,) for pair in pairs for x in pair], "fp bigint")).collect()}
    assert {frozenset(pair) for pair in pairs} <= found
