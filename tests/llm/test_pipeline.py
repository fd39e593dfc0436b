"""The corpus pipeline on the smallest tables: stages, columns, and each stage against brute force or its operator's contract."""

import os
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyvane.llm import simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def shingles(text):
    words = text.lower().split()
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("score", "predicted", "lang_pred", "_keep", "_k", "kept", "fp", "node"):  # names that operators use themselves
        docs = docs.withColumn(name, F.lit("clash"))
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = {r.doc_id: r for r in out.collect()}
        assert all(r["_k"] == r["score"] == "clash" for r in rows.values())
        seen[name] = ({r.doc_id: r for r in docs.collect()}, rows)
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    before, after = seen["quality classifier"]
    assert all(quality_of.get(i) != 1 for i in before.keys() - after.keys())
    assert sum(quality_of.get(i) == 0 for i in after) <= 1
    before, after = seen["SimHash near-dedup"]
    sets = {i: shingles(r.text) for i, r in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert not [(a, b) for a in after for b in after if a < b and alike(a, b) >= 0.8]
    assert all(any(alike(a, b) >= 0.5 for b in before if b < a) for a in before.keys() - after.keys())
    before, after = seen["substring dedup"]
    assert before.keys() == after.keys()
    windows = set()
    for i in sorted(after):
        words = after[i].text.split()
        own = [tuple(words[k : k + 20]) for k in range(len(words) - 19)]
        if after[i].text == before[i].text:
            assert not windows & set(own)
        windows |= set(own)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "n_words", "bin_id", "bin_offset"] and out.count() > 100


def pairs_with_blocks(low, high, n, seed=3):
    """Rows of n pairs of texts: 2i, and 2i + 1 that has a block appended or its tail cut, their similarity from low to high."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        like = low + (high - low) * i / max(1, n - 1)
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(150, 600))]
        more = int((len(words) - 4) * (1 / like - 1))  # new shingles of an appended block
        longer = words + [f"v{rng.randrange(10**9)}" for _ in range(more)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(longer))] if i % 2 else [(2 * i, " ".join(longer)), (2 * i + 1, " ".join(words))]
    return rows


def test_near_dedup_finds_block_edits(spark):
    rows = pairs_with_blocks(0.86, 0.9, 120)
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 240, 2))


def test_near_dedup_measures_similarity(spark, monkeypatch):
    """Groups by brute force: components of the pairs of 0.8 or more, and nothing else goes; also where groups are cut into slices."""
    rows = pairs_with_blocks(0.8, 0.86, 60) + [(i + 1000, t) for i, t in pairs_with_blocks(0.7, 0.795, 60, seed=4)]
    rows += [(5000, "a b c d e f g h"), (5001, "a b c d e f g h i"), (5002, "a b c d e f g"), (5003, ""), (5004, None), (6000, "x y z")]
    sets, root = {i: shingles(t or "") for i, t in rows}, {i: i for i, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(4):
        for a, b in [*pairs, (5003, 5004)]:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(frame).collect()) == sorted({root[i] for i in root})
    groups = spark.createDataFrame([(i, 0) for i in sets], "node long, root long")
    found = {tuple(sorted(r)) for r in simhash.verified_links(frame, groups, most=16).collect()}
    assert found == {(a, b) for a, b in pairs if not (a, b) == (5001, 5002)}
