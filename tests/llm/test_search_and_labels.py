"""Top-k search, personal data, weak labels and the pipeline against plain versions."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from forewarn.llm import logistic, pii, topk, weak_labels
from forewarn.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.sqlcheck import connect, differences

# Top-k


def test_top_k_query_is_the_sql(spark, sf_dir):
    assert not differences(QUERIES["op5_exact_top_k"](spark, sf_dir), connect(sf_dir), SQL["op5_exact_top_k"])


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, block int")


def _check_top(spark, rows, k=5):
    found = topk.exact_top_k(_vectors(spark, rows), F.col("vec_id") % 2 == 0, k)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute.top_k(exact, lambda i: i % 2 == 0, k)


def test_top_k_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 4)
    draw = random.Random(8)
    rows = [(i, [draw.uniform(-2, 2) for _ in range(6)]) for i in range(40)]
    rows += [(i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(100, 130)]  # ties
    rows += [(50, None), (52, []), (54, [float("nan")] * 6), (56, [float("inf")] * 6), (58, [None] * 6), (None, [1.0] * 6)]
    rows = [r for r in rows if r[0] != 52]  # lengths differ elsewhere
    _check_top(spark, rows)
    _check_top(spark, rows[:3])
    _check_top(spark, [(0, [1e30, -1e30]), (2, [1.0, 2.0]), (4, [0.0, 0.0])][1:])
    assert topk.exact_top_k(_vectors(spark, []), F.col("vec_id") % 2 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [3.0e6 + 0.25, 2.0]), (3, [-3.0e6, 1.0])]
    _check_top(spark, rows, 2)


# Personal data

PIECES = [*"0123456789ab.@+- ()%_\n,é", "1.2.3.4", "4845168114407329", "a@b.c", "+1 (459) 555-9246", "..", "256.1.1.1"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_base_spans_are_the_expressions(text):
    assert pii.base_spans(text) == brute.personal_spans(text)
    patterns = {pii.pattern_before(text, s): 3 for s, _ in pii.candidates(text, pii.base_spans(text))}
    spans = pii.all_spans(text, patterns)
    assert set(pii.base_spans(text)) <= set(spans) and spans == sorted(spans)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 80_000, "+" * 80_000, "1." * 80_000, "@" * 80_000):
        pii.candidates(text, pii.base_spans(text))


def test_patterns_find_unseen_identifiers(spark):
    draw = random.Random(9)
    rows = []
    for i in range(60):
        phone = f"+1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}"
        rows.append((i, f"some words {draw.random():.3f} here call me at {phone} or not"))
    rows += [(100 + i, f"please call me at {555000 + i} tonight") for i in range(10)]
    rows += [(200 + i, f"the year was {1900 + i} then") for i in range(10)]
    rows += [(300, None), (301, ""), (None, "call me at 5551234")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    patterns = pii.learn_patterns(docs)
    assert patterns == {"me at": 3}
    found = {r.doc_id: r for r in pii.extract(docs, patterns).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base = brute.personal_spans(text)
        assert found[i].base == pii.joined(base) and found[i].n_phone == len(base)
        assert (found[i].spans != found[i].base) == (i is None or 100 <= i < 200)
    clean = {r.doc_id: r for r in pii.redact(docs, patterns).collect()}
    assert clean[100].text == "please call me at [PHONE] tonight" and clean[200].text == rows[70][1]
    assert clean[300].text is None and clean[301].text == "" and clean[0].spans == "x"
    assert pii.learn_patterns(docs.limit(0)) == {} and pii.extract(docs.limit(0), {}).count() == 0


def test_rare_patterns_are_kept_and_joined(spark):
    rows = [(i, f"mail to user{i}@example.org today", "x") for i in range(7000)]
    rows += [(10_000 + i, f"reach desk{i}@example.org or not", "x") for i in range(6)]  # 6 of 7,006 seeds
    rows += [(20_000, "reach 777123 now, a@b.co too", "x"), (20_000, "reach 777123 now, a@b.co too", "y")]
    rows += [(None, "reach 777123 now, a@b.co too", "z"), (20_001, None, "x"), (20_002, "", "x"), (20_003, "no 12345", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    table = pii.pattern_table(docs)
    patterns = {r.pattern: r.kind for r in table.collect()}
    assert patterns == {"mail to": 0, "reach": 0} == pii.learn_patterns(docs)
    for build in (pii.extract, pii.redact):
        got, want = build(docs, table), build(docs, patterns)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    clean = [r.text for r in pii.redact(docs, table).where("doc_id = 20000 OR doc_id IS NULL").collect()]
    assert clean == ["reach [EMAIL] now, [EMAIL] too"] * 3
    assert pii.extract(docs, table.limit(0)).where("spans <> base").isEmpty()


def test_personal_data_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute.personal_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))


# Weak labels


def test_expectation_maximisation_recovers_accuracies():
    draw = np.random.default_rng(3)
    good = draw.random(40_000) < 0.7
    accuracy = [0.95, 0.8, 0.65, 0.9]
    votes = []
    for a in accuracy:
        right = draw.random(len(good)) < a
        vote = np.where(right == good, weak_labels.ACCEPT, weak_labels.REJECT)
        votes.append(np.where(draw.random(len(good)) < 0.3, weak_labels.NOTHING, vote))
    combinations, counts = np.unique(np.stack(votes, axis=1), axis=0, return_counts=True)
    model = weak_labels.fit_labels(combinations, counts.astype(float))
    assert abs(model.good - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        said = model.tables[j, 1, weak_labels.ACCEPT] / (1 - model.tables[j, 1, weak_labels.NOTHING])
        assert abs(said - a) < 0.04


def test_classifier_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # 40 labels teach little
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorers = weak_labels.fit_scorers(docs, labels.where("doc_id % 2 = 0"))
    scored = weak_labels.score(docs, scorers)
    held = scored.withColumnRenamed("quality", "score").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.kept for r in held if r.quality == 1 and r.toxic == 0]
    junk = [r.score < 0.5 for r in held if r.quality == 0]
    assert np.mean(clean) > 0.9 and np.mean(junk) > 0.85
    assert scored.count() == docs.count()
    kept = weak_labels.keep_good(docs, scorers)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("kept").collect()}


def test_classifier_catches_held_out_toxic(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = weak_labels.score(docs, weak_labels.fit_scorers(docs, labels.where("doc_id % 2 = 0")))
    held = scored.drop("quality").join(labels.where("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    toxic = [(r.lang, r.clean < 0.5) for r in held.collect() if r.toxic == 1]
    assert np.mean([caught for lang, caught in toxic if lang == "en"]) > 0.8
    assert np.mean([caught for _, caught in toxic]) > 0.4


def test_few_labels_keep_the_ratio_of_classes(spark):
    """Six labels on 1,200 documents, a third of which have an insult."""
    draw = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        text = draw.sample(words, 12) + (["idiot", "stupid"] if i % 3 == 0 else [])
        rows.append((i, " ".join(draw.sample(text, len(text)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in (0, 1, 2, 3, 4, 6)], "doc_id long, quality int, toxic int")
    for train_rows in (weak_labels.TRAIN_ROWS, 300):
        scored = weak_labels.score(docs, weak_labels.fit_scorers(docs, labels, train_rows)).collect()
        assert np.mean([r.clean >= 0.5 for r in scored if r.doc_id % 3]) > 0.95
        assert np.mean([r.clean < 0.5 for r in scored if r.doc_id % 3 == 0]) > 0.9


def test_places_for_documents_with_and_without_a_vote():
    for spoken, silent, rows, want in ((5, 5, 20, (5, 5)), (50, 50, 20, (10, 10)), (50, 3, 20, (17, 3)), (3, 50, 20, (3, 17)), (0, 9, 4, (0, 4))):
        assert weak_labels.places_for({True: spoken, False: silent}, rows) == {True: want[0], False: want[1]}


def test_words_rarely_share_a_place():
    words = [b"word%d" % i for i in range(100_000)]
    assert len({p for w in words for p in weak_labels.features([], [], [w])}) > 80_000


def test_classifier_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some plain words stand here", "x"), (3, "plain words again stand here", "x")]
    rows += [(4, "$$$ ### %%% &&& " * 20, "x"), (5, "you stupid worthless idiot and moron", "x"), (6, "w " * 60_000, "x")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), None):
        scorers = weak_labels.fit_scorers(docs, known)
        kept = {(r.doc_id, r.kept) for r in weak_labels.score(docs, scorers).collect()}
        assert (1, False) in kept and (2, False) in kept and (5, False) in kept and (3, True) in kept
    empty = docs.limit(0)
    assert weak_labels.keep_good(empty, weak_labels.fit_scorers(empty, labels)).count() == 0


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns and docs.dtypes == kinds
        kept.append({r.doc_id: r for r in docs.collect()})
    good, single, fresh, safe = kept
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    clean = [r.doc_id in good for r in labels if r.quality == 1 and r.toxic == 0]
    assert np.mean(clean) > 0.9
    expected = brute.near_groups([(i, r.text) for i, r in good.items()], 5, 80)
    assert set(single) == {i for i in good if expected[i][1] == i}
    assert set(fresh) == set(single) == set(safe)
    assert not brute.repeated_words([(i, r.text) for i, r in fresh.items()], 50)
    for i, r in safe.items():
        assert not brute.personal_spans(r.text) and r.n_chars == len(r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(safe)
    assert len(texts) > len(good) > 0


def test_pipeline_runs_on_extra_columns_and_nulls(spark, sf_dir, tmp_path):
    rows = [(1, "plain words stand here, and more of them follow", "en", "s", 1, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()


def test_scorer_fit_keeps_the_drivers_heap_small(spark, monkeypatch):
    """Weights end at the least value, one class has none, and the fit of the scorers leaves MLlib's optimiser alone."""
    rng = np.random.default_rng(3)
    n, width, penalty = 600, 40, 0.01
    x = (rng.random((n, width)) < rng.random(width) * 0.5).astype(float)
    x[:, 7] = 0
    x[:, 0] = 1
    chance = 1 / (1 + np.exp(-x @ rng.normal(size=width)))
    up, down = chance * rng.integers(1, 4, n), (1 - chance) * rng.integers(1, 4, n)
    rows = [([int(p) for p in np.flatnonzero(r)], float(u), float(d)) for r, u, d in zip(x, up, down)]
    kind = "places array<int>, up double, down double"
    weights, bias = logistic.fit(spark.createDataFrame(rows, kind).repartition(3), width, penalty, 100)
    ones, exact = np.hstack([x, np.ones((n, 1))]), np.zeros(width + 1)
    held, total = np.append(np.full(width, penalty), 0), (up + down).sum()
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-ones @ exact))
        slope = ones.T @ ((up + down) * p - up) / total + held * exact
        exact -= np.linalg.solve((ones.T * ((up + down) * p * (1 - p))) @ ones / total + np.diag(held), slope)
    # Each round stops at a gain of a millionth of the loss.
    assert np.abs(np.append(weights, bias) - exact).max() < 0.02
    assert weights[7] == 0
    weights, bias = logistic.fit(spark.createDataFrame([([0], 1.0, 0.0), ([1], 2.0, 0.0)], kind), 2, penalty, 5)
    assert not weights.any() and bias == np.inf

    from pyspark.ml.classification import LogisticRegression

    monkeypatch.setattr(LogisticRegression, "fit", None)
    docs = spark.createDataFrame([(i, f"plain words number {i} stand here" if i % 2 else "$$$ ### @@@ ***") for i in range(60)], "doc_id long, text string")
    kept = weak_labels.keep_good(docs, weak_labels.fit_scorers(docs, None))
    assert {r.doc_id % 2 for r in kept.collect()} == {1}
