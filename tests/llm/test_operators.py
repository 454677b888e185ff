"""Each operator against brute force, a round trip or held-out accuracy, and on awkward tables."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import (
    decontamination, jaccard, labelled, language_model, licenses, neighbours, packing, pii, quality, sharding, toxicity,
)

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"
EXTRA = "key string, score double, hub long, lo int, w string, n long, size long, row long, part int, words long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def documents(spark, texts, first=0):
    clash = ("x", 1.0, 2, 3, "w", 4, 5, 6, 7, 8)
    rows = [(None if t == "no id" else first + i, t, "en", "s", None if t is None else len(t), *clash) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(i)}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(5)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t ", "no id", "one", "one", long, long + " tail", "é ü 日本 \x00\x1f ½", "word " * 50, prose(rng, 40)]
    again = documents(spark, texts)
    return again.unionByName(again.where("doc_id in (4, 10)")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, ["x"]).where("false")


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# similarity join


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_components(texts):
    sets = shingle_sets(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def near_copies(rng, families=12, each=7):
    texts = []
    for _ in range(families):
        base = prose(rng, int(rng.integers(3, 260))).split()
        for _ in range(each):
            words = list(base)
            for _ in range(int(rng.integers(0, 1 + len(words) // 25))):
                words[int(rng.integers(len(words)))] = f"x{int(rng.integers(10**6))}"
            base = words if rng.random() < 0.3 else base  # chains of copies too
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("group", [jaccard.GROUP, 40])
def test_components_equal_brute_force(spark, group):
    texts = near_copies(np.random.default_rng(1)) + [None, "", "a", "A", "a b"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(spark, texts), group=group).collect()}
    assert got == brute_components(texts)


def test_join_on_awkward_tables(spark, awkward, empty):
    got = sorted(jaccard.join(awkward).collect(), key=str)
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_shingles == by_id[1].n_shingles == by_id[2].n_shingles == 0
    assert by_id[1].component_id == 1 and by_id[5].component_id == 4 and by_id[7].component_id == 6
    assert jaccard.join(empty).count() == 0
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 4, 6, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("group", [jaccard.GROUP, 3000, 300])
def test_groups_around_the_threshold(spark, group):
    """Several hundred texts of similarity 0.4 to 0.8 with each other, in tasks of many segments, few and parts of one."""
    rng = np.random.default_rng(12)
    texts = []
    for size, share, many in ((120, 0.03, 330), (60, 0.05, 110), (90, 0.08, 110)):
        base = prose(rng, size, 10**6).split()
        for _ in range(many):
            words = list(base)
            for at in rng.choice(size, int(size * share * rng.uniform(0.3, 1.2)), replace=False):
                words[int(at)] = f"x{int(rng.integers(10**6))}"
            texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(spark, texts), group=group).collect()}
    want = brute_components(texts)
    assert got == want and 20 < len({c for _, c in want.values()}) < 500


@pytest.mark.parametrize("tasks", [12, 80])
def test_strangers_are_no_family(monkeypatch, tasks):
    """Where a task holds few segments, or part of one, it connects partners, not texts that have next to nothing there."""
    import pyarrow as pa
    import pyarrow.compute

    monkeypatch.setattr(jaccard, "LONG", 16)
    rng = np.random.default_rng(15)
    line = prose(rng, 12, 10**6)  # many have it
    texts = [f"{line} {prose(rng, 80, 10**6)}" for _ in range(1500)]
    texts += [texts[0] + " tail", texts[1] + " tail"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    _, sets, keys = next(jaccard._sets(batch))
    number = int(jaccard.scheme_of(np.array([len(sets[0])]))[0])
    packed = pa.Table.from_batches(jaccard._subsets({number: tasks}, np.unique(sets[0][np.isin(sets[0], sets[9])]))([batch]))
    links = set()
    for task in packed["task"].unique().to_pylist():
        found = jaccard._match(jaccard.scheme(number), task % (1 << 40), tasks, packed.filter(pa.compute.equal(packed["task"], task)))
        links |= set(zip(found["key"].to_pylist(), found["other"].to_pylist(), strict=True))
    named = keys.view(np.int64).tolist()
    assert {frozenset(x) for x in links} == {frozenset((named[0], named[-2])), frozenset((named[1], named[-1]))}


def test_families_of_several_blocks(spark, monkeypatch):
    """Blocks of seven documents that meet each other, and few comparisons at a time."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = np.random.default_rng(14)
    texts = []
    for share in (0.02, 0.06):
        base = prose(rng, 80, 10**6).split()
        for _ in range(45):
            words = list(base)
            for at in rng.choice(80, int(80 * share * rng.uniform(0.3, 1.2)), replace=False):
                words[int(at)] = f"x{int(rng.integers(10**6))}"
            texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_keep_one_goes_by_row(spark):
    rng = np.random.default_rng(13)
    a, b, c = (prose(rng, 60, 10**6) for _ in range(3))
    rows = [(1, a), (2, b), (2, a + " tail"), (3, b + " tail"), (2, c), (None, c + " tail"), (None, "q r s t u v"), (None, "q r s t u v"), (4, ""), (4, ""), (5, None)]
    table = spark.createDataFrame([(i, t, "en", "s", 1, *("x", 1.0, 2, 3, "w", 4, 5, 6, 7, 8)) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(table).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (2, c), (None, "q r s t u v"), (4, ""), (4, ""), (5, None)], key=str)


def test_only_rows_that_go_are_listed(spark, monkeypatch):
    """The table that texts are joined with grows with what is dropped or comes twice, not with what stays."""
    counts, rng = [], np.random.default_rng(16)
    monkeypatch.setattr(jaccard, "small", lambda rows: (counts.append(rows.count()), rows)[1])
    texts = [prose(rng, 60, 10**6) for _ in range(40)]
    table = documents(spark, texts + [texts[0] + " tail", texts[0] + " end"]).unionByName(documents(spark, [texts[0]]))
    kept = sorted(r.doc_id for r in jaccard.keep_one(table).collect())
    assert kept == list(range(40)) and counts == [3]


def test_all_labelled_documents_calibrate(spark, monkeypatch):
    rng = np.random.default_rng(17)
    ys = [int(i % 3 == 0) for i in range(300)]
    docs = documents(spark, [f"the {prose(rng, 30)}{' vile rotten scum' * y}" for y in ys])
    labels = spark.createDataFrame(list(enumerate(ys)), "doc_id long, toxic int")
    seen, calibrate = [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda *a: (seen.append(int(sum(a[4])) if len(a) > 4 else len(a[3])), calibrate(*a)))
    model = toxicity.train(docs.unionByName(docs), labels, F.lit(True), 20)
    assert seen == [8, 300 - 32]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == bool(y) for i, y in enumerate(ys)) > 290


def test_every_language_has_a_threshold():
    """Ten documents of either label move their language's threshold against a thousand others; errors weigh by label."""
    model = toxicity.Model(*[None] * 6, np.zeros(5))
    logit = np.concatenate((np.linspace(-9, -1, 1000), np.linspace(3, 9, 1000), np.linspace(3.5, 4, 10), np.linspace(6, 8, 10)))
    language, y = np.repeat([1, 2], [2000, 20]), np.repeat([0, 1, 0, 1], [1000, 1000, 10, 10])
    toxicity.calibrate(model, logit, language, y)
    assert -1 < model.thresholds[1] < 3 and 4 < model.thresholds[2] < 6 and model.thresholds[3] < 3
    assert ((logit >= model.thresholds[language]) == y).all() and 0 < model.slope < 10
    for costs, low, high in (((1.0, 1.0), 1, 2), ((0.1, 1.0), 0, 1)):  # three clean ones at a tenth are less than a toxic one
        toxicity.calibrate(model, np.array([0.0, 1.0, 1.0, 2.0]), np.ones(4, int), np.array([0, 1, 0, 1]), np.array([50, 1, 3, 1]), np.array(costs))
        assert low < model.thresholds[1] < high


def test_samples_hold_one_text_for_each_id(spark):
    docs = documents(spark, ["a", "b", "c", "d"]).unionByName(documents(spark, ["other a"] * 50)).select("doc_id", "text")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1), (2, 0), (3, None), (4, 7), (None, 1)], "doc_id long, toxic int")
    texts, ys = labelled.sample(docs.withColumn("doc_id", F.when(F.col("text") == "other a", 0).otherwise(F.col("doc_id"))), labels, "toxic", F.lit(True), 10)
    assert ys == [1, 0] and texts[0] in ("a", "other a") and texts[1] == "b"


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 3, 50, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 10 :], rng.integers(0, 2**63, n // 4).astype(np.uint64))))
        x, y = (np.array(s, np.int64).view(np.uint64) for s in jaccard._sketches([a, b]).to_pylist())
        while len(x) != len(y):
            x, y = (s if len(s) == min(len(x), len(y)) else s[: len(s) // 2] ^ s[len(s) // 2 :] for s in (x, y))
        assert sum(bin(int(v)).count("1") for v in x ^ y) <= len(np.setxor1d(a, b))


# nearest neighbours


def test_neighbours_equal_brute_force_and_relaxation_keeps_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    vectors = centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 8))
    vectors[100:160] = vectors[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(None, [1.0] * 8), (901, None), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [None] + [1.0] * 7), (905, [])]
    other = [(920, [1.0, 2.0]), (940, [2.0, 1.0])]
    table = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, k=10, shard_rows=250, block_rows=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    scores = vectors @ vectors.T
    for q in range(0, 900, 20):
        best = sorted((-scores[q, j].round(9), j) for j in range(900) if j != q)[:10]
        assert [got[q][k + 1][0] for k in range(10)] == [j for _, j in best]
    assert [v for v, _ in got[920].values()] == [940] and got[940][1] == (920, 4.0)
    relaxed = neighbours.search(table, F.col("vec_id") % 20 == 0, k=10, factor=0.8, shard_rows=250).where("query_id < 900")
    hits = sum(r.vec_id in {v for v, _ in got[r.query_id].values()} for r in relaxed.collect())
    assert hits >= 0.9 * 450
    assert neighbours.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# classifiers


@pytest.mark.parametrize(("module", "label", "folds", "held"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_classifiers_on_held_out_documents(spark, awkward, empty, module, label, folds, held):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = labelled.fold(F.col("doc_id"), folds)
    model = module.train(docs, labels, fold != held)
    scored = module.score(docs.where(fold == held), model).join(labels, "doc_id").collect()
    good = sum((r.score >= 0.5) == (r[label] == 1) for r in scored)
    share = max(sum(r[label] == y for r in scored) for y in (0, 1))
    assert good >= 0.95 * len(scored) and good > share
    out = module.score(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert module.score(empty, model).count() == 0
    none = module.train(docs, labels.where("false"), fold != held)
    assert {r.score for r in module.score(awkward, none).collect()} == {0.0}
    one = module.train(docs, labels.where(f"{label} = 1"), fold != held)
    assert {r.score for r in module.score(awkward, one).collect()} == {1.0}
    if module is toxicity:
        assert module.drop_toxic(awkward, 0.0).columns == awkward.columns


def test_folds_are_crc32():
    assert zlib.crc32(b"17") % 5 == 2


def test_fold_of_null(spark):
    row = spark.range(17, 18).select(labelled.fold(F.col("id"), 5), labelled.fold(F.lit(None).cast("long"), 5)).first()
    assert tuple(row) == (zlib.crc32(b"17") % 5, -1)


# benchmark overlaps


def brute_overlaps(docs, items):
    out = {}
    split = lambda t: (t or "").lower().split()
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            size = min(15, len(v))
            for m in decontamination.MASKS:
                for a in range(len(w) - 8):
                    for b in range(len(v) - 8):
                        if any(c == "1" and w[a + k] != v[b + k] for k, c in enumerate(m)):
                            continue
                        for s in range(9 - size, 1):
                            if min(a, b) + s >= 0 and a + s + size <= len(w) and b + s + size <= len(v):
                                same = sum(w[a + s + k] == v[b + s + k] for k in range(size))
                                if same >= np.ceil(0.8 * size):
                                    out[d, i] = max(out.get((d, i), 0), same)
    return out


def test_overlaps_equal_brute_force(spark, awkward, empty):
    rng = np.random.default_rng(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((9, 12, 15, 40, 8))]
    docs = []
    for d in range(30):
        words = prose(rng, 400 if d % 3 else 20).split()
        passage = items[d % 5][1].split()
        for k in rng.choice(len(passage), size=d % 4, replace=False):
            passage[k] = "changed"
        docs.append((d, " ".join(words[:13] + passage[: len(passage) - d % 2 * 3] + words[13:])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9, None), (None, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.find(table, bench).collect()}
    assert got == brute_overlaps(docs, items) and len(got) > 10
    assert decontamination.decontaminate(table, bench).count() == 30 - len({d for d, _ in got})
    assert decontamination.find(awkward, bench).count() == 0 and decontamination.find(empty, bench).count() == 0
    assert decontamination.decontaminate(awkward, bench).columns == awkward.columns
    assert decontamination.find(table, bench.where("false")).count() == 0


def test_long_windows_across_chunks(spark):
    rng = np.random.default_rng(8)
    item = prose(rng, 60, 10**6)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [f"{prose(rng, 226, 10**6)} {item} {prose(rng, 300, 10**6)}"])
    got = decontamination.find(docs, bench, window=60).first()
    assert got and (got.matched, got.compared, got.first_word) == (60, 60, 226)


def test_masks_hit_every_window_with_three_substitutions():
    from itertools import combinations

    placed = [
        {s + i for i, c in enumerate(m) if c == "1"} for m in decontamination.MASKS for s in range(15 - len(m) + 1)
    ]
    assert all(any(not p & set(c) for p in placed) for c in combinations(range(15), 3))


# sharding


def test_shards_are_equal_in_bytes(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard(docs, 24).toPandas()
    assert sorted(got.doc_id) == list(range(1000))
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 24 and per.max() - per.min() < got["size"].max() and per.max() < 1.06 * per.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    one = docs.limit(1).collect()[0]
    mine = got[got.doc_id == one.doc_id].iloc[0]
    assert mine["size"] == len(one.text.encode()) + 8 and mine.text_crc32 == zlib.crc32(one.text.encode())
    same = documents(spark, ["same text"] * 300)
    assert sharding.shard(same, 7).groupBy("shard").count().toPandas()["count"].between(41, 45).all()
    odd = sharding.shard(awkward, 3).toPandas()
    assert len(odd) == awkward.count() and odd[odd.doc_id == 0]["size"].tolist() == [8]
    assert sharding.shard(empty, 3).count() == 0
    assert sharding.shard_by_bytes(same, 1000).select("shard").distinct().count() == 5


# pseudo-likelihood


def test_pseudo_likelihood(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_model.train(docs)
    got = {r.doc_id: r for r in language_model.score(docs, model).collect()}
    plain = language_model.Model.of_counts(language_model.count_words(docs))
    plain.weights[3][:] = 0  # classes by their shares alone
    base = {r.doc_id: r for r in language_model.score(docs, plain).collect()}
    assert sum(r.log_likelihood for r in got.values()) > sum(r.log_likelihood for r in base.values())
    text = docs.where("doc_id = 2").first().text
    hashes = language_model.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
    bucket, expected = language_model.buckets(hashes), 0.0
    e, mixing, bias, output, shift = (w.astype(float) for w in model.weights)
    for i, b in enumerate(bucket):
        hidden = bias.copy()
        for o, m in zip(language_model.OFFSETS, mixing, strict=True):
            inside = 0 <= i + o < len(bucket)
            hidden += e[model.inputs[bucket[i + o]] if inside else 1] @ m
        z = np.maximum(hidden, 0) @ output + shift
        expected += z[model.classes[b]] - np.log(np.exp(z).sum()) + model.within[b]
    assert got[2].n_words == len(bucket) and got[2].log_likelihood == pytest.approx(expected, rel=1e-4)
    total = np.bincount(model.classes, np.exp(model.within), language_model.CLASSES)
    assert np.allclose(total[total > 0], 1)
    odd = language_model.score(awkward, model).collect()
    assert len(odd) == awkward.count()
    assert {(r.n_words, r.log_likelihood, r.mean_log_likelihood) for r in odd if r.doc_id in (0, 1, 2)} == {(0, 0.0, None)}
    assert language_model.train(empty) is None and language_model.score(empty, None).count() == 0


def test_word_shares_are_exact(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 500)  # most words by the join
    texts = [" ".join(f"t{i * 90 + j % 90}" for j in range(180)) + " the" * 20 for i in range(900)]
    docs = documents(spark, [*texts, None, ""])
    counts = {r.key: r.n for r in language_model.count_words(docs).collect()}
    assert sorted(counts.values())[-2:] == [2, 18_000] and len(counts) == 81_001  # more words than there were buckets
    model = language_model.train(docs)
    assert len(model.keys) == 1
    exact = np.log(2 / np.maximum(model.total, 0.5))
    for text in (texts[0], texts[899], "the unheard", "unheard"):
        raw = np.frombuffer(text.encode(), np.uint8)
        keys = language_model.buckets(language_model.words(raw, np.array([0, len(raw)]))[0])
        expected = sum(model.within[k] for k in keys)
        chunk = language_model.encode(documents(spark, [text]), model).first()
        assert chunk.shares[0] == pytest.approx(expected)
        assert all(model.within[k] == pytest.approx(exact[model.classes[k]]) for k in keys if counts.get(k) == 2)
    assert model.within[language_model.buckets(np.array([12345], np.uint64))[0]] == pytest.approx(np.log(0.5 / model.total[-1]))
    own = {r.doc_id: r.log_likelihood for r in language_model.train_and_score(docs).collect()}
    assert own == pytest.approx({r.doc_id: r.log_likelihood for r in language_model.score(docs, model).collect()}, rel=1e-3)
    assert len(own) == 902


def test_every_word_is_a_training_target(spark):
    docs = documents(spark, ["one", "two words", *(prose(np.random.default_rng(i), 37 + i) for i in range(9)), None])
    model = language_model.Model.of_counts(language_model.count_words(docs))
    chunks, windows = language_model.encode(docs, model), 0
    for turn in range(language_model.ROUNDS):
        run = language_model._training(model.for_tasks(False), turn)
        windows += sum(r.windows for r in chunks.mapInArrow(run, "task long, windows long, weights binary").collect())
    assert windows == 3 + sum(37 + i for i in range(9))
    taken = [language_model.targets(turn, 101) for turn in range(language_model.ROUNDS)]
    assert sorted(np.concatenate(taken)) == list(range(101))


# packing


def test_packing_is_an_exact_cut_of_all_tokens(spark, awkward, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer())
    texts = [r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").limit(60).collect()]
    texts += [None, "", "<|endoftext|> a", "it’s 日本 x² don't  \n\n y", "\x1c\x85 ", "aːb ʰ"]
    docs = documents(spark, texts).repartition(3)
    got = packing.pack(docs, tokenizer(), open_windows=4, merged=8).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.doc_tokens.eq(len(ids)).all() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048
    assert len(packing.pack(awkward, tokenizer()).select("doc_tokens").where("doc_id is null").collect()) == 1
    assert packing.pack(empty, tokenizer()).count() == 0


def test_windows_place_best_fit_and_emit_the_fullest():
    windows = packing.Windows(10, 2)
    assert windows.place(6) == (0, 0, None) and windows.place(7) == (1, 0, None)
    assert windows.place(3) == (1, 7, 1)  # fills the fuller one
    assert windows.place(8) == (2, 0, None)
    assert windows.place(9) == (3, 0, 2)  # none fits: the fullest goes
    assert windows.open() == [3, 0]


# licenses


def test_licenses_equal_brute_force(spark, awkward, empty):
    split = lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) if w]
    rng = np.random.default_rng(6)
    texts = []
    for i in range(40):
        notice = licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1].split()
        if i % 4 == 3:
            notice = notice[: max(5, len(notice) * 9 // 10)]
        texts.append(prose(rng, i * 7) + " " + " ".join(notice) + " " + prose(rng, 1200 if i % 5 == 0 else 3))
    docs = documents(spark, texts)
    got = {(r.doc_id, r.template_id): (r.matched, r.first_word) for r in licenses.scan(docs, licenses.templates(spark)).collect()}
    expected = {}
    for d, text in enumerate(texts):
        w = split(text)
        for t, (_, notice) in enumerate(licenses.TEMPLATES):
            v = split(notice)
            grams, step = {tuple(v[k : k + 5]) for k in range(len(v) - 4)}, max(1, len(v) // 4)
            best = max(
                ((len(grams & {tuple(w[k : k + 5]) for k in range(s, min(s + len(v) + step - 1, len(w)) - 4)}), -s) for s in range(0, max(1, len(w) - 4), step)),
            )
            if best[0] >= 0.75 * len(grams):
                expected[d, t] = (best[0], -best[1])
    assert got == expected and len(got) >= 40
    assert licenses.scan(awkward, licenses.templates(spark)).count() == 0
    assert licenses.scan(empty, licenses.templates(spark)).count() == 0


# personal data


def brute_patterns(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_patterns_equal_brute_force():
    rng = np.random.default_rng(7)
    for alphabet in ("01259.@+- ab%(11", "0.@a-", "0123456789 -", "+1 ()9-."):
        for _ in range(4000):
            text = "".join(rng.choice(list(alphabet), int(rng.integers(45))))
            assert pii.patterns(text) == brute_patterns(text)


def test_field_spreads_labels_to_recurring_tokens():
    seen = [f"call +1 415 555 {i:04d} or mail user{i}@mail.example.org now" for i in range(60)]
    model = pii.fit(seen + [f"in {1900 + i} there were {i * 37} of them" for i in range(60)])
    base, added = pii.find(["ask user7@mail.example.org, then user7@mail. again", "the year 1984 and 512 more", ""], model)
    assert [len(b) for b in base] == [1, 0, 0] and added[1:] == [[], []]
    graph = pii.Graph()
    text = "4111 1111 1111 1111"
    graph.add(0, "card 4111111111111111 then 4111111111111111x", pii.patterns("card 4111111111111111 then 4111111111111111x"))
    assert [e[2] for e in graph.edges] == [0] and pii.patterns(text)
    far = "pay 4111111111111111 " + "and so on " * 30 + "again 4111111111111111."
    graph = pii.Graph()
    graph.add(0, far, [])
    graph.seen[0] = 3
    pair = np.zeros((2, 5, 5))
    pair[1] = 4 * np.eye(5)
    assert pii.marginals(graph, np.zeros((pii.FEATURES, 5)), pair)[1].argmax() == 3  # over a skip edge only


def test_every_recurrence_of_a_matched_number_is_found():
    seen = [f"call +1415555{i:04d} now, " + "and so on " * 9 + f"so +1415555{i:04d} it is" for i in range(60)]
    model = pii.fit(seen + [f"in {1900 + i} there were {i * 37} of them and {5550000 + i * 7919} more" for i in range(60)])
    for first in ("+14155550123", "+1 (415) 555-0123"):
        bare = "".join("and so on it goes, 4155550123 was said once more, not 4155550199. " for _ in range(60))
        text = f"call {first} today. {bare}"
        base, added = pii.find([text], model)
        assert len(base[0]) == 1 and [(k, text[a:b]) for a, k, b in added[0]] == [(3, "4155550123")] * 60
        assert pii.masked(text, base[0] + added[0]).count("<phone>") == 61
    chain = pii.Graph()
    chain.add(0, " ".join(f"{i}x" for i in range(200)), [])
    chain.seen[0] = 3
    pair = np.zeros((2, 5, 5))
    pair[0] = 8 * np.eye(5)
    exact = np.linalg.matrix_power(np.exp(pair[0]) / np.exp(pair[0]).sum(1), 199)[3]
    assert np.allclose(pii.marginals(chain, np.zeros((pii.FEATURES, 5)), pair)[-1], exact, atol=0.01)  # messages came to rest


def test_report_and_redaction(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.report(docs, model).collect():
        base = brute_patterns(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, pii.shown(base).split(","))) <= set(r.spans.split(","))
    masked = pii.redact(docs, model)
    assert masked.columns == docs.columns
    assert all(not pii.patterns(r.text) for r in masked.limit(300).collect())
    assert pii.report(awkward, model).count() == awkward.count() == pii.redact(awkward, model).count()
    assert pii.report(awkward, model).where("doc_id = 0").first().spans == ""
    assert pii.scan(empty, pii.train(empty)).count() == 0
