"""What the tasks of a reused worker keep in memory, and that slices of a batch do not show in results."""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trackspark.llm import jaccard, pii, text, toxicity
from trackspark.llm.components import components

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return [t for t in pq.read_table(f"{TINY}/documents.parquet")["text"].to_pylist() if t]


def test_sets_hash_small_slices(texts, monkeypatch):
    monkeypatch.setattr(text, "_powers", [])
    many = (texts * (1 + (5 << 20) // sum(map(len, texts))))[::-1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(many)), pa.int64()), pa.array(many)], ["doc_id", "text"])
    steps = list(jaccard._sets(batch))
    assert [i for i, _, _ in steps] == np.cumsum([0, *(len(found) for _, found, _ in steps)])[:-1].tolist()
    assert len(steps) == -(-sum(len(t.encode()) for t in many) // jaccard.STEP)
    longest = max(text.SMALL_SLICE, *(len(t.encode()) for t in texts))
    assert len(text._powers[0]) <= 2 * longest + 1 < jaccard.STEP
    whole = {t: k for k, t in zip(next(jaccard._sets(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])))[2].tolist(), texts)}
    assert [k for _, _, keys in steps for k in keys.tolist()] == [whole[t] for t in many]


def test_toxicity_scores_a_text_by_itself(texts, monkeypatch):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, len(texts)).tolist()
    model = toxicity.fit([t + " vile rotten scum" * y for t, y in zip(texts, labels, strict=True)], labels)
    batch = pa.array([*texts, "", "vile rotten scum", "", "plain words", "rotten scum vile", None], pa.large_string())
    together = model.scores(batch)
    alone = np.array([model.scores(batch[i : i + 1])[0] for i in range(len(batch))])
    assert np.allclose(together, alone, rtol=0, atol=1e-9)
    monkeypatch.setattr(toxicity, "SMALL_SLICE", 1 << 10)
    assert np.allclose(model.scores(batch), together, rtol=0, atol=1e-9)


@pytest.mark.parametrize("module, train", [
    (toxicity, lambda docs, labels: toxicity.train(docs, labels, F.lit(True))),
    (pii, lambda docs, labels: pii.train(docs)),
])
def test_driver_gives_memory_back_after_a_fit(spark, monkeypatch, module, train):
    calls = []
    monkeypatch.setattr(module, "release", lambda: calls.append(1))
    train(*(spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels")))
    assert calls == [1]


def tasks_of(spark, run):
    """What ``run`` returns, and how many tasks its jobs had."""
    sc = spark.sparkContext
    sc.setJobGroup(group := uuid.uuid4().hex, "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := sc.statusTracker().getStageInfo(s)))


def test_links_that_are_stars_take_no_round(spark):
    """The driver keeps something of every task, so rounds that change nothing cost it memory."""
    links = spark.createDataFrame([(k % 5, k) for k in range(5, 400)] + [(k, k) for k in range(3)] + [(401, 400)], "a long, b long")
    found, tasks = tasks_of(spark, lambda: components(links.repartition(8)).collect())
    assert sorted((r.node, r.root) for r in found) == sorted([(k, k % 5) for k in range(400)] + [(400, 400), (401, 400)])
    assert tasks <= 40


def test_components_of_chains_rings_and_hubs(spark):
    rng = np.random.default_rng(23)
    links = [(k, k + 1) for k in range(-40, 0)] + [(100 + k, 100 + (k + 1) % 30) for k in range(30)] + [(999, 1000 + k) for k in range(300)]
    links += [tuple(x) for x in rng.integers(2000, 2400, (220, 2)).tolist()] + [(999, 2001), (3000, 3000)]
    root = {x: x for link in links for x in link if link[0] != link[1]}

    def least(x):
        return x if root[x] == x else least(root[x])

    for a, b in links:
        if a != b:
            low, high = sorted((least(a), least(b)))
            root[high] = low
    found = components(spark.createDataFrame(links + links[::3] + [b[::-1] for b in links[::2]], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in found) == sorted((x, least(x)) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
