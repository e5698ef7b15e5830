"""Repeated passages found by content-defined chunking.

A gear rolling hash over the last ``WINDOW`` bytes ends a chunk at about one word end in ``AVERAGE``; an insertion moves
no boundary but those next to it, so a passage gives the same chunks wherever it stands, but for its edges. Chunks are
deduplicated by a 64-bit digest: the first occurrence, by document and place, stays, and each later one names it as its
source. A passage is removed where later chunks follow each other as their sources do: at least ``LEAST_WORDS`` words of
chunks on one diagonal (same source document, same distance in chunks), with nothing but repeated chunks between them; or
at least ``RUN_WORDS`` words in a row are repeated, ``LEAST_WORDS`` of them in chunks of ``LONG_CHUNK`` words or more.
Chunks that agree by chance, such as a few common words, lie on no common diagonal and stay.

Digests are reduced to their first occurrence in each Arrow batch before the shuffle, so a passage in a third of all
documents sends one row per batch to its task; later occurrences go to a task by document. The task reads its sorted
rows as a stream and holds no group.

Rows with one id are one document: equal chunks in equal places of such rows are not repeats of each other. Rows without
an id, and null or empty texts, are left as they are and are nobody's source. Other columns are kept.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forewarn.llm.common import enter, sealed, ship, slices, unsealed, with_changed
from forewarn.llm.gear import rolling

WINDOW = 16
AVERAGE = 5
LEAST_WORDS = 12
RUN_WORDS = 30
LONG_CHUNK = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

Chunks = tuple[np.ndarray, np.ndarray, np.ndarray]  # first byte, end byte, words


def chunks(data: bytes) -> Chunks:
    """Chunks of whole words; white space between chunks belongs to none."""
    if not data:
        return (np.zeros(0, np.int64),) * 3
    values = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_SPACE[values], [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    starts = starts[: len(ends)]
    if not len(ends):
        return (np.zeros(0, np.int64),) * 3
    last = np.flatnonzero(rolling(values, WINDOW)[ends - 1] % np.uint64(AVERAGE) == 0)
    if not len(last) or last[-1] != len(ends) - 1:
        last = np.append(last, len(ends) - 1)
    first = np.concatenate(([0], last[:-1] + 1))
    return starts[first], ends[last], last - first + 1


def digests(data: bytes, cut: Chunks) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    values = [digest(data[s:e]) for s, e in zip(cut[0].tolist(), cut[1].tolist())]
    return np.array(values, np.uint64).view(np.int64)


_FOUND = "doc_id long, place int, digest long, source_id long, source_place int"


def repeated_chunks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Later occurrences of chunks with their sources: doc_id, place, digest, source_id, source_place."""
    ship(texts.sparkSession)
    rows = texts.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND text <> ''")
    names = ["doc_id", "place", "digest", "source_id", "source_place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup.cut")
        for batch in batches:
            parts = []
            for name, content in (pair for part in slices(batch) for pair in zip(*(part.column(i).to_pylist() for i in (0, 1)))):
                data = content.encode()
                found = digests(data, chunks(data))
                parts.append((np.full(len(found), name, np.int64), np.arange(len(found), dtype=np.int32), found))
            if not parts:
                continue
            doc, place, digest = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((place, doc, digest))
            yield _with_sources(names, doc[order], place[order], digest[order], None)[0]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            known = ~np.isnan(batch.column(3).to_numpy(zero_copy_only=False).astype(float))
            if known.any():
                yield batch.filter(pa.array(known))
            doc, place, digest = (c[~known] for c in columns)
            if len(doc):
                out, held = _with_sources(names, doc, place, digest, held)
                yield out.filter(out.column(3).is_valid())

    local = rows.mapInArrow(cut, _FOUND)
    # Firsts of a batch meet by digest, the others need no meeting.
    home = F.when(F.col("source_id").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "place"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = local.repartitionById(parts, F.pmod(home, F.lit(parts)).cast("int"))
    return met.sortWithinPartitions("digest", "doc_id", "place").mapInArrow(settle, _FOUND)


def _with_sources(names, doc, place, digest, held) -> tuple[pa.RecordBatch, tuple]:
    """Rows sorted by (digest, doc, place) with the first row of each digest as the others' source.

    ``held`` is the first row of the digest that the previous batch ended with. A row in the same document and
    place as its source is no repeat.
    """
    new = np.concatenate(([True], digest[1:] != digest[:-1]))
    at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    source_doc, source_place = doc[at], place[at]
    if held is not None and held[0] == digest[0]:
        run = at == 0
        source_doc, source_place = np.where(run, held[1], source_doc), np.where(run, held[2], source_place)
    first = (source_doc == doc) & (source_place == place)
    arrays = [pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(digest, pa.int64())]
    arrays += [pa.array(source_doc, pa.int64(), mask=first), pa.array(source_place.astype(np.int32), pa.int32(), mask=first)]
    return pa.RecordBatch.from_arrays(arrays, names), (digest[-1], source_doc[-1], source_place[-1])


def passages(words: np.ndarray, places: list[int], sources: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """Runs of chunks (first, last) to remove: stretches of one diagonal with only repeated chunks between them."""
    repeated = set(places)
    stretches: dict[tuple[int, int], list[int]] = {}  # diagonal -> [first, last, words]
    done = []
    for place, (source, source_place) in sorted(zip(places, sources)):
        diagonal = (source, place - source_place)
        run = stretches.get(diagonal)
        if run is not None and all(p in repeated for p in range(run[1] + 1, place)):
            run[1] = place
            run[2] += int(words[place])
        else:
            if run is not None:
                done.append(run)
            stretches[diagonal] = [place, place, int(words[place])]
    done += stretches.values()
    found = {(first, last) for first, last, n in done if n >= least_words}
    # A long run of repeats whose sources are scattered, as in copies of copies: long chunks don't agree by chance.
    ordered = sorted(repeated)
    breaks = [i for i in range(1, len(ordered)) if ordered[i] != ordered[i - 1] + 1]
    for i, j in zip([0, *breaks], [*breaks, len(ordered)]):
        run = words[ordered[i:j]] if i < j else words[:0]
        if run.sum() >= RUN_WORDS and run[run >= LONG_CHUNK].sum() >= least_words:
            found.add((ordered[i], ordered[j - 1]))
    return sorted(found)


def removed_spans(text: str, found: list, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Byte ranges of a text to remove, in order and apart, each up to the next word that stays."""
    data = text.encode()
    cut = chunks(data)
    own = digests(data, cut)
    # Places of another text with the same id don't hold here.
    here: dict[int, tuple[int, int]] = {}
    for f in found:
        place, source = f["place"], (f["source_id"], f["source_place"])
        if place < len(own) and own[place] == f["digest"]:
            # Repeated rows may name several sources of one chunk; it counts once.
            here[place] = min(source, here.get(place, source))
    spans: list[tuple[int, int]] = []
    for first, last in passages(cut[2], list(here), list(here.values()), least_words):
        start = int(cut[0][first])
        end = int(cut[0][last + 1]) if last + 1 < len(own) else len(data)
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans


def without_passages(
    texts: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text", removed: str | None = None
) -> DataFrame:
    """The table with later occurrences of passages taken out of its text.

    With ``removed``, a column of that name lists the ranges taken out, as start:end in code points of the old text.
    """
    found = repeated_chunks(texts, key, text)
    entry = F.struct("place", "digest", "source_id", "source_place")
    by_doc = found.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set(entry).alias("_found"))
    rows = sealed(texts, text).withColumn("_id", F.col(f"row.c{texts.columns.index(key)}").cast("long"))
    joined = rows.join(by_doc, F.col("_id") == F.col("_of"), "left")

    def clean(content: str | None, entries: list | None) -> tuple[str | None, str]:
        if content is None or not entries:
            return content, ""
        data, parts, done, at, marks = content.encode(), [], 0, 0, []
        for start, end in removed_spans(content, entries, least_words):
            kept = data[done:start]
            parts.append(kept)
            at += len(kept.decode())
            length = len(data[start:end].decode())
            marks.append(f"{at}:{at + length}")
            at += length
            done = end
        parts.append(data[done:])
        return b"".join(parts).decode(), ",".join(marks)

    kept = with_changed(joined.select("row", "text", "_found"), ["text", "_found"], ["text", "removed"], clean)
    columns = unsealed(texts.columns, text)
    if removed:
        columns.append(F.col("removed").alias(removed))
    return kept.select(*columns)
