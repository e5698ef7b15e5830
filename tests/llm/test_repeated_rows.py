"""Rows repeated many times, and columns of the caller with the names of helpers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forewarn.llm import common, near_dedup, pii, substring_dedup, token_counts, weak_labels

WORDS = "alpha bravo carol delta early fancy grape happy index joker karma lemon mango night ocean piano queen river".split()
PASSAGE = " ".join(f"{w}{i}" for i, w in enumerate(WORDS * 3))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_short_shared_chunk_stays_however_often_its_row_is_repeated(spark):
    one = "this row shares only three words alpha bravo carol with another one here"
    rows = [(1, "first come alpha bravo carol and then it ends quite differently")] + [(2, one)] * 500
    out = substring_dedup.without_passages(table(spark, rows)).where("doc_id = 2").distinct().collect()
    assert [r["text"] for r in out] == [one]


def test_passages_go_from_repeated_rows_as_from_one(spark):
    own = "a beginning of its own " + PASSAGE + " and an end of its own"
    left = set()
    for n in (1, 40):
        rows = [(1, "before " + PASSAGE + " after")] + [(2, own)] * n + [(2, "another text of the same id")]
        out = substring_dedup.without_passages(table(spark, rows)).where("doc_id = 2")
        texts = {r["text"]: r["count"] for r in out.groupBy("text").count().collect()}
        assert texts.pop("another text of the same id") == 1
        ((text, count),) = texts.items()
        assert count == n and "karma28" not in text and "a beginning" in text and "its own" in text[-20:]
        left.add(text)
    assert len(left) == 1


def test_repeated_rows_are_one_node(spark):
    near = PASSAGE.replace("queen16", "other")
    rows = [(5, PASSAGE)] * 3000 + [(9, near)] * 2000 + [(7, "something else entirely, said once")] + [(7, near)] + [(None, near)]
    groups = near_dedup.near_duplicate_groups(table(spark, rows), 3, 85)
    found = {tuple(r)[:4]: r["count"] for r in groups.groupBy("doc_id", "n_shingles", "component_id", "kept").count().collect()}
    n = len(PASSAGE.split()) - 2
    assert found == {(5, n, 5, True): 3000, (9, n, 5, False): 2000, (7, 3, 5, False): 1, (7, n, 5, False): 1, (None, n, None, True): 1}


def test_repeated_rows_are_one_example(spark, monkeypatch):
    rows = [(1, "fine prose, said with care and many different words")] * 400 + [(i, f"you idiot number {i}!") for i in range(2, 42)]
    docs, labels = table(spark, rows), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    stage = weak_labels.stage_table

    def watched(df, name, *more):
        out = stage(df, name, *more)
        if name == "weak-train":
            seen.append(out.agg(F.count("*").alias("n"), F.sum("stands").alias("weight")).first())
        return out

    monkeypatch.setattr(weak_labels, "stage_table", watched)
    weak_labels.fit_scorers(docs, labels, train_rows=30)
    assert seen and all(r["n"] <= 30 for r in seen)
    assert all(r["weight"] == pytest.approx(440) for r in seen)


NAMES = "_bucket _at _hit _bitmap _found _digest _of _clean _gone _id row none c0 a.b t`x n start kind place digest hash".split()


@pytest.mark.parametrize("stage", ["redact", "without_passages", "near", "good"])
def test_columns_of_any_name_come_back_unchanged(spark, stage):
    rows = [(i, f"mail me at person{i}@example.com, contact: {PASSAGE if i % 2 else 'short text'} {i}") for i in range(6)]
    docs = table(spark, rows + rows[:2])
    for i, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    docs = docs.withColumn("N_CHARS", F.lit(3))
    if stage == "redact":
        out = pii.redact(docs, spark.createDataFrame([("contact", 0)], "pattern string, kind int"))
        assert not out.where("text LIKE '%@%'").count()
    elif stage == "without_passages":
        out = substring_dedup.without_passages(docs)
    elif stage == "near":
        out = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    else:
        scorers = weak_labels.fit_scorers(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
        out = weak_labels.keep_good(docs, scorers)
    assert out.columns == docs.columns
    for r in out.collect():
        values = r.asDict()
        assert [values[name] for name in NAMES] == [f"{i}:{r['doc_id']}" for i in range(len(NAMES))] and values["N_CHARS"] == 3


def test_batches_are_read_in_slices():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["x" * 1_000_000] * 20), pa.array(range(20))], names=["t", "i"])
    parts = list(common.slices(batch))
    assert len(parts) > 3 and [i for p in parts for i in p.column(1).to_pylist()] == list(range(20))
    assert list(common.slices(batch.slice(0, 0))) == []


def test_cache_of_line_starts_is_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    counter = token_counts.TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    text = "\n".join(f"word{i}" for i in range(300))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.count(text) == len(model.encode(text)) and len(counter._known) <= 51
