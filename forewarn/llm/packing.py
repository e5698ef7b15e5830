"""Packing of tokenised documents into sequences of a fixed capacity by bin completion.

Spark tokenises and cuts the documents and counts how many pieces there are of each length; these counts, at most
``capacity`` numbers however many documents there are, are all that the planner needs. It fills sequences around the
largest remaining length: undominated fillings of the rest are enumerated, the one with least waste first, and applied
to as many sequences as the counts allow. The plan of best fit (largest first) is the first incumbent; the search goes
back to other fillings while waste so far leaves room for fewer sequences than the incumbent has, up to a number of
nodes, and ends at once where the incumbent meets the lower bound.

The plan says, for each length, which ranks of the pieces of that length go to which sequences. Pieces are ranked by
counting inside each writing task and adding the totals of the tasks before it, so no length needs to meet in one task.

Nulls are read as empty texts, which give the one closing token. Repeated rows are packed as often as they occur; an
empty table gives no sequences. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from functools import lru_cache
from itertools import chain
from typing import Iterator, Mapping

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forewarn.llm.common import forget_after, give_back, map_rows, stage_table

CAPACITY = 2048
#: Words a worker remembers, and words encoded at once.
REMEMBERED = 400_000
AT_ONCE = 1000
#: Characters of text whose unseen words are encoded together.
TOGETHER = 1_000_000
#: Fillings tried in one place, and places in the search.
BRANCHES = 4
NODES = 6000
#: Splits tried at a time for plans that the search starts from.
SPLITS = 16


# How the tokenizer cuts words (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that may be cut here: Latin-1, no special token, and none of the white space that ASCII lacks.
_PLAIN = re.compile(r"[^\x85\xa0<\u0100-\U0010ffff]*\Z").match


class WordTokens:
    """Ids of a tokenizer that lower-cases and never joins what white space parts, remembered word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        #: A special token parts the words that are encoded at once; words that hold one go alone.
        self._comma = "<|startoftext|>"
        self._comma_id = self._tokenizer.token_to_id(self._comma)
        if self._comma_id is None or self._alone("A b\n c") != b"".join(map(self._alone, "abc")):
            raise ValueError("the tokenizer must lower-case, drop white space and know the special token")
        self._cut = regex.compile(_SPLIT).findall
        # The same merges over lines, without normalising and cutting.
        lines = json.loads(self._tokenizer.to_str())
        lines["normalizer"] = None
        lines["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]}
        self._lines = Tokenizer.from_str(json.dumps(lines))
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {}
        tries = ["don't", "Ünï-42²x", "a'S", "\xad\x7f!"]
        if self._ids([word.encode() for word in tries]) != list(map(self._alone, tries)):
            raise ValueError("the tokenizer doesn't cut and merge as expected")

    def _alone(self, word: str) -> bytes:
        return np.asarray(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        cut: dict[int, list[str]] = {}
        rest = []
        for i, word in enumerate(map(bytes.decode, words)):
            # Latin-1 words need no normalising but lower case, and are cut here as the tokenizer cuts them.
            if _PLAIN(word):
                cut[i] = [word.lower()] if word.isalpha() else self._cut(word.lower())
            else:
                rest.append(i)
        if cut:
            self._merge(set(chain.from_iterable(cut.values())))
        known = self._parts
        for i, parts in cut.items():
            out[i] = known[parts[0]] if len(parts) == 1 else b"".join([known[part] for part in parts])
        for start in range(0, len(rest), AT_ONCE):
            some = rest[start : start + AT_ONCE]
            for i, ids in zip(some, self._together([words[i].decode() for i in some])):
                out[i] = ids
        return out

    def _merge(self, parts: set[str]) -> None:
        """Remember the ids of parts; each ends with the only token of it that ends a word."""
        unseen = parts.difference(self._parts)
        if len(self._parts) + len(unseen) > REMEMBERED:
            self._parts.clear()
            unseen = parts
        unseen = list(unseen)
        for i in range(0, len(unseen), AT_ONCE):
            some = unseen[i : i + AT_ONCE]
            ids = np.asarray(self._lines.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(ends) != len(some):
                raise ValueError("a part must have one last token")
            packed, start = ids.tobytes(), 0
            for part, end in zip(some, ends.tolist()):
                self._parts[part] = packed[start:end]
                start = end

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words by the whole tokenizer, encoded at once."""
        if any("<|" in word for word in words):
            return [self._alone(word) for word in words]
        ids = self._tokenizer.encode_batch_fast([self._comma.join(words)], add_special_tokens=False)[0].ids
        ids = np.asarray(ids, "<u4")
        packed, start, out = ids.tobytes(), 0, []
        for end in (np.flatnonzero(ids == self._comma_id) * 4).tolist():
            out.append(packed[start:end])
            start = end + 4
        return [*out, packed[start:]]

    def encode(self, text: str) -> bytes:
        """Packed ids. Words are parted at ASCII white space, which every definition of white space has."""
        return next(iter(self.encode_all([text])))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text; unseen words of all of them are encoded together."""
        split = [self._words(text) for text in texts]
        unseen = set().union(*split).difference(self._known)
        if len(self._known) + len(unseen) > REMEMBERED:
            self._known.clear()
            unseen = set().union(*split)
        unseen = list(unseen)
        self._known.update(zip(unseen, self._ids(unseen)))
        for words in split:
            yield b"".join(map(self._known.__getitem__, words))

    @staticmethod
    def _words(text: str) -> list[bytes]:
        data = text.encode()
        if b"<|" not in data:
            data = data.lower()  # the ASCII letters, which the tokenizer would lower-case too
        return data.split()


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    tokens = WordTokens(path)
    give_back()  # reading a tokenizer takes several times what it is
    return tokens


forget_after(word_tokens.cache_clear)


def _together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in groups of about ``TOGETHER`` characters of text."""
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += len(row[1] or "")
        if n >= TOGETHER:
            yield some
            some, n = [], 0
    if some:
        yield some


def token_pieces(
    texts: DataFrame, path: str, capacity: int = CAPACITY, close: int = 0, keep_ids: bool = True,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: key, piece, start, length, ids_crc32, ids, and (chunk, nth).

    ``nth`` counts the pieces of one length in one task, ``chunk``.
    """
    end = np.asarray([close], "<u4").tobytes()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        tokens, chunk = word_tokens(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for some in _together(incoming):
            for (name, _), packed in zip(some, tokens.encode_all([content or "" for _, content in some])):
                packed += end
                for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    length = len(part) // 4
                    ids = part if keep_ids else None
                    yield name, piece, at // 4, length, zlib.crc32(part), ids, chunk, seen[length]
                    seen[length] += 1

    kind = dict(texts.dtypes)[key]
    schema = (
        f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, ids binary, chunk int, nth long"
    )
    return map_rows(texts.select(key, text), rows, schema)


def pack_documents(
    texts: DataFrame, path: str, capacity: int = CAPACITY, close: int = 0, keep_ids: bool = True,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The pieces of all texts with ``sequence_id`` and ``offset``."""
    pieces = stage_table(token_pieces(texts, path, capacity, close, keep_ids, key, text), "packing-pieces")
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces that have ``length``, ``chunk`` and ``nth``."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = stage_table(counts, "packing-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = "length long, first_rank long, last_rank long, copies long, first_sequence long, first_offset long"
    plan = spark.createDataFrame(layout(plan_sequences(lengths, capacity)), schema)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(offsets, ["chunk", "length"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    # The plan has a few rows for each of at most ``capacity`` lengths.
    part = F.broadcast(plan.withColumnRenamed("length", "of_length"))
    within = F.col("rank") - F.col("first_rank")
    hit = (F.col("length") == F.col("of_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    return (
        ranked.join(part, hit)
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(within / F.col("copies")))
        .withColumn("offset", F.col("first_offset") + F.pmod(within, "copies") * F.col("length"))
        .drop("chunk", "nth", "ahead", "rank", *part.columns)
    )


# A plan is a list of (times, {length: copies}): so many sequences, each with these pieces.
Plan = list[tuple[int, dict[int, int]]]


def layout(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """For each length the ranks that go to each run of sequences, and where in them."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for length, copies in sorted(filling.items(), reverse=True):
            first = used.get(length, 0)
            used[length] = first + times * copies
            rows.append((length, first, used[length] - 1, copies, sequence, offset))
            offset += length * copies
        sequence += times
    return rows


def sequences_of(plan: Plan) -> int:
    return sum(times for times, _ in plan)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of sequences: long pieces can't share one, and their waste can't be filled by too long ones."""
    lengths = np.arange(capacity + 1)
    number, tokens = np.cumsum(counts), np.cumsum(counts * lengths)
    if not number[-1]:
        return 0
    best = -(-int(tokens[-1]) // capacity)
    half = capacity // 2
    # With threshold t: pieces over capacity - t stand alone, those over half need one each, the rest from t fill up.
    t = np.arange(half + 1)
    alone = number[-1] - number[capacity - t]
    large = number[capacity - t] - number[half]
    large_tokens = tokens[capacity - t] - tokens[half]
    below = np.where(t > 0, tokens[np.maximum(t - 1, 0)], 0)
    small_tokens = tokens[half] - below
    extra = np.maximum(0, -(-(small_tokens - (large * capacity - large_tokens)) // capacity))
    return max(best, int((alone + large + extra).max()))


def best_fit(lengths: Mapping[int, int], capacity: int) -> Plan:
    """Best fit, largest first, for all pieces of a length at once."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by room left
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, times: int, filling: dict[int, int]) -> None:
        open_.setdefault(room, []).append((times, filling))
        rooms[room] = True

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                times, filling = open_[room].pop()
                rooms[room] = bool(open_[room])
            else:
                room, times, filling = capacity, left, {}
            copies = min(room // length, left)
            now = min(times, left // copies)
            if times > now and filling:
                put(room, times - now, filling)
            put(room - copies * length, now, filling | {length: copies})
            left -= now * copies
    return [group for groups in open_.values() for group in groups]


def fillings(counts: np.ndarray, room: int, branches: int) -> list[tuple[int, ...]]:
    """Undominated sets of one to three further pieces for ``room``, least waste first.

    The largest piece that fits dominates every other single one, and for a given first piece the largest second
    one dominates; a set is left out where a single piece of the same or a greater sum is there. Threes are
    tried only where ones and twos leave waste.
    """
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    floor_of = np.maximum.accumulate(np.where(counts[: room + 1] > 0, np.arange(room + 1), 0))
    one = int(floor_of[room])
    found = [(one, (one,))]
    if one < room:
        first = have
        second = floor_of[room - first]
        second = np.where((second == first) & (counts[first] < 2), floor_of[np.maximum(second - 1, 0)], second)
        total = first + second
        good = (second > 0) & (second <= first) & (total > one)
        order = np.lexsort((-first[good], -total[good]))[:branches]
        found += [(int(s), (int(a), int(b))) for s, a, b in zip(total[good][order], first[good][order], second[good][order])]
        best = max(s for s, _ in found)
        if best < room:
            # A spread of first pieces, each with its best pair for what is left; full ones come before all others, those
            # with the largest first piece in front.
            full = 0
            for a in first[np.linspace(0, len(first) - 1, min(len(first), 24)).astype(int)][::-1]:
                a = int(a)
                counts[a] -= 1
                rest = floor_of[: room - a + 1]
                pair = have[have <= min(a, room - a)]
                third = rest[room - a - pair]
                good = (third > 0) & (third <= pair) & (counts[pair] > (third == pair)) & (counts[third] > 0)
                if good.any():
                    total = np.where(good, pair + third, 0)
                    i = int(total.argmax())
                    if a + total[i] > best:
                        found.append((int(a + total[i]), (a, int(pair[i]), int(third[i]))))
                        full += a + total[i] == room
                counts[a] += 1
                if full == branches:
                    break
    found.sort(key=lambda f: (-f[0], len(f[1]), tuple(-x for x in f[1])))
    return [filling for _, filling in found[:branches]]


def _filled(counts: np.ndarray, pieces: tuple[int, ...], capacity: int) -> tuple[int, dict[int, int], int]:
    """How often a sequence with these pieces, and shorter ones as they still fit, can be made; its pieces and waste."""
    held: dict[int, int] = {}
    for length in pieces:
        held[length] = held.get(length, 0) + 1
    room = capacity - sum(pieces)
    while room > 0:
        have = np.flatnonzero(counts[: room + 1])[::-1]
        more = next((c for c in map(int, have) if counts[c] > held.get(c, 0)), None)
        if more is None:
            break
        held[more] = held.get(more, 0) + 1
        room -= more
    return min(int(counts[length]) // n for length, n in held.items()), held, room


def split_fit(lengths: Mapping[int, int], capacity: int, split: int, below: float = math.inf) -> Plan | None:
    """Pieces over ``split`` with the largest piece that fits next to them, the others in the fullest fillings.

    Where sequences hold two or three pieces, the largest should stand in pairs, or they use up the short pieces that
    make threes; which are the largest depends on the lengths. It ends with None as soon as the plan can't have fewer
    sequences than ``below``.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    plan: Plan = []
    done = 0
    while len(have := np.flatnonzero(counts)):
        if done + lower_bound(counts, capacity) >= below:
            return None
        largest = int(have[-1])
        counts[largest] -= 1
        room = capacity - largest
        if largest > split:
            further = tuple(int(c) for c in np.flatnonzero(counts[: room + 1])[-1:])
        else:
            further = fillings(counts, room, 1)[0]
        counts[largest] += 1
        times, held, _ = _filled(counts, (largest, *further), capacity)
        for length, n in held.items():
            counts[length] -= times * n
        plan.append((times, held))
        done += times
    return plan


def best_split(lengths: Mapping[int, int], capacity: int, enough: int, below: float = math.inf) -> Plan:
    """The best of ``split_fit`` over splits spread among the lengths, then over splits around the best one.

    Plans that can't be the best are left unfinished. Of the second splits, none is wanted that isn't ``below`` as well.
    """
    known = sorted(lengths)
    best: Plan | None = None
    low, high, fewest = 0, len(known) - 1, math.inf
    for _ in range(2):
        places = sorted({int(i) for i in np.linspace(low, high, SPLITS)})
        at = places[0]
        for place in places:
            found = split_fit(lengths, capacity, known[place], fewest)
            if found is not None:
                best, at, fewest = found, place, sequences_of(found)
            if fewest <= enough:
                return best
        fewest = min(fewest, below)
        around = places.index(at)
        low, high = places[max(0, around - 1)], places[min(len(places) - 1, around + 1)]
    return best


def plan_sequences(lengths: Mapping[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Few sequences for these counts of lengths; deterministic."""
    if not lengths:
        return []
    if min(lengths) < 1 or max(lengths) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    best = best_fit(lengths, capacity)
    fewest, least = sequences_of(best), lower_bound(counts, capacity)
    if fewest > least:
        best = min(best, best_split(lengths, capacity, least, fewest), key=sequences_of)
        fewest = sequences_of(best)
    tokens = int((counts * np.arange(capacity + 1)).sum())
    # Depth first: each entry is (counts, sequences so far, waste so far, link to the plan so far).
    stack: list[tuple[np.ndarray, int, int, tuple | None]] = [(counts, 0, 0, None)]
    while stack and fewest > least and nodes:
        nodes -= 1
        counts, done, waste, link = stack.pop()
        have = np.flatnonzero(counts)
        if not len(have):
            if done < fewest:
                fewest, best = done, _unlinked(link)
            continue
        # Room for waste if one sequence less than the incumbent is to be reached.
        if waste > (fewest - 1) * capacity - tokens or done + lower_bound(counts, capacity) >= fewest:
            continue
        largest = int(have[-1])
        counts[largest] -= 1
        options = fillings(counts, capacity - largest, BRANCHES)
        counts[largest] += 1
        for filling in reversed(options):
            times, pieces, room = _filled(counts, (largest, *filling), capacity)
            after = counts.copy()
            for length, n in pieces.items():
                after[length] -= times * n
            stack.append((after, done + times, waste + times * room, (link, (times, pieces))))
    return best


def _unlinked(link: tuple | None) -> Plan:
    plan: Plan = []
    while link:
        link, entry = link
        plan.append(entry)
    return plan[::-1]
