"""Document quality from weak labels: expectation maximisation over heuristic labellers, then a hashed linear scorer.

Heuristic labellers look at a text from different sides and vote accept, reject or nothing. Two tasks have labellers of
their own: quality (is this prose?) and toxicity (is it free of insults?). A table of human labels, where there is one, is
one more labeller of each task: it says nothing about most documents, and its accuracy is estimated like the others'.

Spark counts how often each combination of votes occurs over all documents; there are at most 3 ** (number of labellers)
combinations, whatever the size of the corpus. Expectation maximisation on these counts estimates for each labeller how
it votes on good and on bad documents, and for each combination the chance that the document is good. Those chances
label at most ``TRAIN_ROWS`` documents for each task, and a logistic regression over hashed words and votes is fitted on
them. Documents with and without a vote get half of the places each, what one of them leaves goes to the other; they are
taken by the smallest hashes of their ids and weighted back to how many of each the corpus has, so that few human labels
don't change the ratio of the classes. The scorer decides about every document, by its whole text.

Null and empty texts, and texts without words, are rejected. Rows without an id are scored like others, but neither
labelled nor used for fitting. Repeated rows get the same result. Other columns are ignored by the scores and kept by
the filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from typing import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.llm import logistic
from forewarn.llm.common import enter, forget_after, map_rows, ship, slices, stage_table, with_changed

NOTHING, ACCEPT, REJECT = 0, 1, 2
TASKS = ("quality", "toxicity")
#: Width of the hashed feature space and documents to fit on.
WIDTH = 1 << 18
TRAIN_ROWS = 30_000
ITERATIONS = 40
REGULARISATION = 0.001
REMEMBERED = 200_000

_SYMBOLS = b"#$%&*@^~|<>{}[]\\=_+"
_TRIPLES = [bytes([c]) * 3 for c in b"#$%&*@^~|_=+"]
_MARKS = b".,;:!?\"'()-" + _SYMBOLS
# Common insults, in two overlapping lists: what people are called, and what they or their doings are called.
_NAMES = frozenset(b"idiot moron loser clown scum trash fool imbecile dumbass bastard bitch asshole".split())
_JUDGEMENTS = frozenset(b"stupid pathetic worthless disgusting trash scum dumb ugly filthy vile disgrace garbage".split())
_STRONG = frozenset(b"idiot moron stupid pathetic worthless disgusting loser clown bastard bitch asshole shit fuck".split())


def _between(value: float, accept: float, reject: float) -> int:
    """Accept up to a value, reject from another one, nothing between."""
    return ACCEPT if value <= accept else REJECT if value >= reject else NOTHING


def votes(text: str | None) -> tuple[list[int], list[int], list[bytes]]:
    """Votes for quality and for toxicity, and the text's words in lower case without the marks around them."""
    data = (text or "").encode()
    raw = data.split()
    if not raw:
        return [REJECT] * 7, [NOTHING] * 3, []
    n = len(raw)
    letters = len(data.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = letters - len(data.translate(None, b" \t\n\r\x0b\x0c" + _SYMBOLS))
    capitals = sum(map(bytes.isupper, raw))
    equal = sum(a == b for a, b in pairwise(raw))
    lower = data.lower().split()
    words = [w.strip(_MARKS) for w in lower]
    bare = words.count(b"")
    shouts = data.count(b"!!") + data.count(b"??")
    tripled = sum(map(data.count, _TRIPLES))
    distinct = len(set(words))
    quality = [
        _between(symbols / letters, 0.01, 0.04),
        _between(capitals / n, 0.2, 0.6),
        _between(equal / n, 0.05, 0.2),
        _between(bare / n, 0.03, 0.1),
        _between(tripled / n, 0.01, 0.1),
        _between(shouts / n, 0.01, 0.2),
        # Few different words for the length: the number of them grows about as its square root.
        _between(n**0.5 / distinct, 0.6, 1.5) if n >= 20 else NOTHING,
    ]
    seen = set(words)
    toxicity = [REJECT if not seen.isdisjoint(insults) else NOTHING for insults in (_NAMES, _JUDGEMENTS, _STRONG)]
    return quality, toxicity, words


class _Places(dict):
    """Remembered places of words in the hashed feature space."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word) % WIDTH
        return value


_PLACES = _Places()
forget_after(_PLACES.clear)


def features(quality: Sequence[int], toxicity: Sequence[int], words: list[bytes]) -> list[int]:
    """Places of a text's features: its distinct words and its votes."""
    if len(_PLACES) > REMEMBERED:
        _PLACES.clear()
    named = [b"vote %d %d" % (i, v) for i, v in enumerate([*quality, *toxicity]) if v != NOTHING]
    return sorted({_PLACES[f] for f in {*words, *named}})


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for each labeller how it votes on bad (0) and good (1) documents."""

    good: float
    tables: np.ndarray  # (labellers, 2, 3)

    def posterior(self, combinations: np.ndarray) -> np.ndarray:
        """Chance of being good for rows of votes."""
        logs = np.log(self.tables)
        score = np.tile(np.log([1 - self.good, self.good]), (len(combinations), 1))
        for j in range(combinations.shape[1]):
            score += logs[j][:, combinations[:, j]].T
        score -= score.max(axis=1, keepdims=True)
        chances = np.exp(score)
        return chances[:, 1] / chances.sum(axis=1)


def fit_labels(combinations: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.9) -> LabelModel:
    """Expectation maximisation over distinct combinations of votes and how often each occurs.

    Labellers are specialists, each looking for one fault, so it starts with a single rejection as a likely fault
    and more as a sure one, and with ``prior`` where nobody votes. A count of one is added to every cell, and
    of two where a labeller is right, so that labels of the classes can't be swapped and no chance is 0.
    """
    accepts, rejects = (combinations == ACCEPT).sum(axis=1), (combinations == REJECT).sum(axis=1)
    good = np.where(rejects > 1, 0.05, np.where(rejects == 1, 0.3, np.where(accepts > 0, 0.95, prior)))
    labellers = combinations.shape[1]
    smooth = np.ones((2, 3))
    smooth[0, REJECT] += 2
    smooth[1, ACCEPT] += 2
    tables = np.zeros((labellers, 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        for j in range(labellers):
            for v in (NOTHING, ACCEPT, REJECT):
                tables[j, :, v] = weight[:, combinations[:, j] == v].sum(axis=1)
        tables += smooth
        tables /= tables.sum(axis=2, keepdims=True)
        share = float((weight[1].sum() + 1) / (counts.sum() + 2))
        model = LabelModel(share, tables.copy())
        after = model.posterior(combinations)
        if np.abs(after - good).max() < 1e-6:
            break
        good = after
    return model


_VOTES = "doc_id long, hash long, quality array<int>, toxicity array<int>"


def _identified(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))


def all_votes(texts: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Votes of all labellers for rows with an id; ``labels`` (doc_id, quality, toxic) adds one to each task."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for name, digest, content in incoming:
            quality, toxicity, _ = votes(content)
            yield name, digest, quality, toxicity

    ids = _identified(texts, key, text).where("doc_id IS NOT NULL")
    voted = stage_table(map_rows(ids, rows, _VOTES), "weak-votes")
    if labels is None:
        return voted
    human = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.avg(F.col("quality").cast("double")).alias("q"), F.avg(F.col("toxic").cast("double")).alias("t")
    )
    vote = lambda c, good: F.when(F.col(c).isNull(), NOTHING).when((F.col(c) >= 0.5) == F.lit(good), ACCEPT).otherwise(REJECT)
    joined = voted.join(human, "doc_id", "left")
    return joined.select(
        "doc_id",
        "hash",
        F.concat("quality", F.array(vote("q", True))).alias("quality"),
        F.concat("toxicity", F.array(vote("t", False))).alias("toxicity"),
    )


def label_models(voted: DataFrame) -> dict[str, tuple[LabelModel, DataFrame, dict[bool, int]]]:
    """For each task its model, the combinations with their chance of being good, as a small table, and how many
    documents have a vote and how many have none."""
    spark, out = voted.sparkSession, {}
    for task in TASKS:
        rows = voted.groupBy(task).agg(F.count(F.lit(1)).alias("n")).orderBy(task).collect()  # at most 3 ** labellers
        if not rows:
            return {}
        combinations = np.array([r[task] for r in rows], np.int64)
        counts = np.array([r["n"] for r in rows], np.int64)
        model = fit_labels(combinations, counts.astype(float))
        chances = [(r[task], float(p)) for r, p in zip(rows, model.posterior(combinations))]
        spoken = (combinations != NOTHING).any(axis=1)
        sizes = {True: int(counts[spoken].sum()), False: int(counts[~spoken].sum())}
        out[task] = model, spark.createDataFrame(chances, f"{task} array<int>, good_{task} double"), sizes
    return out


def places_for(sizes: Mapping[bool, int], train_rows: int) -> dict[bool, int]:
    """Documents with and without a vote to fit on: half each, what one of them leaves goes to the other."""
    spoken = min(sizes[True], max(train_rows - train_rows // 2, train_rows - sizes[False]))
    return {True: spoken, False: min(sizes[False], train_rows - spoken)}


def fit_scorers(
    texts: DataFrame,
    labels: DataFrame | None,
    train_rows: int = TRAIN_ROWS,
    key: str = "doc_id",
    text: str = "text",
) -> dict[str, tuple[np.ndarray, float]]:
    """Weights and bias of the scorer of each task."""
    ship(texts.sparkSession)
    voted = stage_table(all_votes(texts, labels, key, text), "weak-all-votes")
    models = label_models(voted)
    if not models:
        return {task: (np.zeros(WIDTH), 0.0) for task in TASKS}
    ids = _identified(texts, key, text)

    def places(content: str | None) -> tuple[list[int]]:
        return (features(*votes(content)),)

    scorers = {}
    for task, (_, chances, sizes) in models.items():
        # Repeated rows are one example that weighs as many times more.
        distinct = voted.groupBy("doc_id", "hash", task).agg(F.count(F.lit(1)).alias("n"))
        rated = distinct.join(F.broadcast(chances), task)  # at most 3 ** labellers rows
        rated = rated.select(
            "doc_id",
            "hash",
            "n",
            F.col(f"good_{task}").alias("good"),
            F.xxhash64("doc_id").alias("turn"),
            F.exists(task, lambda v: v != NOTHING).alias("spoken"),
        )
        # Those chosen of each kind stand for all of it.
        parts = [
            rated.where(F.col("spoken") == spoken).orderBy("turn", "doc_id", "hash").limit(n)
            for spoken, n in places_for(sizes, train_rows).items()
            if n
        ]
        chosen = stage_table(reduce(DataFrame.unionByName, parts), "weak-chosen")
        held = {r["spoken"]: r["n"] for r in chosen.groupBy("spoken").agg(F.sum("n").alias("n")).collect()}
        stands = F.col("n") * F.when(F.col("spoken"), sizes[True] / held.get(True, 1)).otherwise(sizes[False] / held.get(False, 1))
        chosen = chosen.select("doc_id", "hash", "good", stands.alias("stands"))
        rows = ids.join(F.broadcast(chosen), ["doc_id", "hash"])  # ``train_rows`` rows of a few numbers
        rows = rows.groupBy("doc_id", "hash").agg(*[F.first(c).alias(c) for c in ("text", "good", "stands")])
        rows = stage_table(with_changed(rows.select("text", "good", "stands"), ["text"], ["places"], places, "array<int>").drop("text"), "weak-train")
        # A row counts for both classes, as much as it is likely to be of each.
        side = lambda chance: F.when(chance > 0.001, chance * F.col("stands")).otherwise(0.0)
        train = rows.select("places", side(F.col("good")).alias("up"), side(1 - F.col("good")).alias("down"))
        scorers[task] = logistic.fit(train, WIDTH, REGULARISATION, ITERATIONS)
    return scorers


def _score(scorers: Mapping[str, tuple[np.ndarray, float]], text: str | None) -> list[float]:
    quality, toxicity, words = votes(text)
    if not words:
        return [0.0, 1.0]
    at = features(quality, toxicity, words)
    logits = [scorers[task][0][at].sum() + scorers[task][1] for task in TASKS]
    return [float(1 / (1 + np.exp(-x))) for x in np.clip(logits, -500, 500)]


def score(texts: DataFrame, scorers: Mapping[str, tuple[np.ndarray, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its key, ``quality`` and ``clean`` (chances of good prose and of no insult) and ``kept``."""
    held = texts.sparkSession.sparkContext.broadcast(dict(scorers))  # two vectors of WIDTH numbers

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for name, content in incoming:
            quality, clean = _score(held.value, content)
            yield name, quality, clean, quality >= 0.5 and clean >= 0.5

    kind = dict(texts.dtypes)[key]
    return map_rows(texts.select(key, text), rows, f"`{key}` {kind}, quality double, clean double, kept boolean")


def keep_good(texts: DataFrame, scorers: Mapping[str, tuple[np.ndarray, float]], text: str = "text") -> DataFrame:
    """The rows that the scorers accept, unchanged."""
    ship(texts.sparkSession)
    held = texts.sparkSession.sparkContext.broadcast(dict(scorers))

    place = texts.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("weak_labels.keep_good")
        for batch in batches:
            for part in slices(batch):
                good = [min(_score(held.value, content)) >= 0.5 for content in part.column(place).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    plain = texts.toDF(*[f"c{i}" for i in range(len(texts.columns))])  # Spark's batches need plain names
    return plain.mapInArrow(kept, plain.schema).toDF(*texts.columns)
