"""Personal data: exact forms, and identifiers found by the words in front of them.

Four exact forms (email, ip, card, phone) are the seeds. Every seed, and every other token that could be an
identifier (at least ``LEAST_DIGITS`` digits, or an ``@``), is an instance; the two words in front of it are its pattern.
Spark counts which patterns stand before which instances and scores this graph for some rounds: the confidence of a
pattern for a kind is the score of its distinct instances over their number (plus ``SMOOTHING``), and an unseen
instance gets the chance that at least one of its patterns is right. Patterns that are confident and stand before enough
different seeds are kept, as a table: their number grows with the corpus. Tokens behind a kept pattern are spans of its
kind; the tokens are joined to the table by pattern, and what is found to the texts by the texts' digests.

Spans are in code points, end exclusive; base spans of different kinds may overlap each other, found ones overlap
nothing. Nulls are read as empty texts. Texts of any length are read whole, in time proportional to their length.
Repeated rows give repeated results and don't count as further evidence, as only distinct instances count.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator, Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.llm.common import map_rows, sealed, stage_table, unsealed, with_changed
from forewarn.llm.prefilter import split

KINDS = ("email", "ip", "card", "phone")
LEAST_DIGITS = 4
ROUNDS = 3
SMOOTHING = 1.0
LEAST_CONFIDENCE = 0.6
LEAST_SEEDS = 5
#: A pattern is looked for in so many characters.
REACH = 80
#: Parts into which the tokens behind one pattern are dealt.
SALTS = 32

Span = tuple[int, int, int]  # start, kind (place in KINDS), end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# The look-behind only keeps a failing run of digits from being tried again at each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_NOT_DIGIT = re.compile("[^0-9]+")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*").finditer
_EDGE = "\"'.,;:!?()[]{}<>|*#$%&"
_TRIGGER = re.compile("[0-9@]").search
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the exact forms by start, then kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [(start, 0, end) for start, end in _emails(text)]
    if "+" in text:
        for m in _PHONE(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    if _DIGIT.search(text):
        for m in _IP(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
    spans.sort()
    return spans


def pattern_before(text: str, start: int) -> str:
    """The two words in front, lower-cased and with digits made alike."""
    return " ".join(_DIGIT.sub("0", word.lower()) for word in text[max(0, start - REACH) : start].split()[-2:])


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Other tokens that could be identifiers, without the marks at their edges."""
    if not _TRIGGER(text):
        return []
    found, at, covered = [], 0, sorted((start, end) for start, _, end in spans)
    reach = 0
    for m in _TOKEN(text):
        token = m[0]
        if "@" not in token and len(_NOT_DIGIT.sub("", token)) < LEAST_DIGITS:
            continue
        body = token.strip(_EDGE)
        start = m.start() + len(token) - len(token.lstrip(_EDGE))
        end = start + len(body)
        while at < len(covered) and covered[at][0] < end:
            reach = max(reach, covered[at][1])
            at += 1
        if body and reach <= start:
            found.append((start, end))
    return found


def all_spans(text: str, patterns: Mapping[str, int]) -> list[Span]:
    """Base spans with those that the patterns find."""
    spans = base_spans(text)
    if patterns:
        found = [(start, patterns.get(pattern_before(text, start)), end) for start, end in candidates(text, spans)]
        spans = sorted(spans + [span for span in found if span[1] is not None])
    return spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _instance(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def occurrences(texts: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct (pattern, instance) of the corpus with the instance's kind, -1 for unseen ones."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for (content,) in incoming:
            if not content or not (_TRIGGER(content) or "+" in content):
                continue
            spans = base_spans(content)
            for start, kind, end in spans:
                yield pattern_before(content, start), _instance(content[start:end]), kind
            for start, end in candidates(content, spans):
                yield pattern_before(content, start), _instance(content[start:end]), -1

    found = map_rows(texts.select(text), rows, "pattern string, instance long, kind int")
    return found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Confidence of each pattern for each kind, and the distinct seeds behind it: (pattern, kind, confidence, seeds).

    ``edges`` are distinct (pattern, instance, kind). Every round is written to the shared folder.
    """
    kinds = range(len(KINDS))
    seeds = edges.where(F.col("kind") >= 0).groupBy("instance").agg(F.max("kind").alias("seed"))
    known = seeds.select("instance", *[(F.col("seed") == k).cast("double").alias(f"s{k}") for k in kinds])
    scores = known
    for turn in range(rounds):
        joined_ = edges.join(scores, "instance", "left")
        means = [(F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) / (F.count(F.lit(1)) + SMOOTHING)).alias(f"c{k}") for k in kinds]
        counts = [F.count_if(F.col("kind") == k).alias(f"n{k}") for k in kinds]
        patterns = stage_table(joined_.groupBy("pattern").agg(*means, *counts), "pii-patterns")
        if turn + 1 < rounds:
            unseen = edges.join(seeds, "instance", "left_anti").join(patterns, "pattern")
            doubt = [F.exp(F.sum(F.log(1 - F.col(f"c{k}")))) for k in kinds]  # a confidence is below 1
            guessed = unseen.groupBy("instance").agg(*[(1 - d).alias(f"s{k}") for k, d in zip(kinds, doubt)])
            scores = stage_table(known.unionByName(guessed), "pii-instances")
    unfolded = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"c{k}").alias("confidence"), F.col(f"n{k}").alias("seeds")) for k in kinds])
    )
    return patterns.select("pattern", unfolded.alias("x")).select("pattern", "x.*")


def pattern_table(
    texts: DataFrame,
    text: str = "text",
    least_confidence: float = LEAST_CONFIDENCE,
    least_seeds: int = LEAST_SEEDS,
) -> DataFrame:
    """Patterns to apply with their kinds, as a table written to the shared folder: (pattern, kind)."""
    if not 0.5 < least_confidence <= 1:
        raise ValueError("a pattern may be confident of one kind only")
    edges = stage_table(occurrences(texts, text), "pii-edges")
    kept = score_patterns(edges).where(
        (F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_seeds) & (F.col("pattern") != "")
    )
    return stage_table(kept.select("pattern", "kind"), "pii-kept")


def learn_patterns(
    texts: DataFrame,
    text: str = "text",
    least_confidence: float = LEAST_CONFIDENCE,
    least_seeds: int = LEAST_SEEDS,
) -> dict[str, int]:
    """``pattern_table`` on the driver, for corpora known to have few patterns."""
    kept = pattern_table(texts, text, least_confidence, least_seeds)
    return {row["pattern"]: row["kind"] for row in kept.collect()}


def _digest(text: str) -> Column:
    return F.sha2(F.encode(F.col(f"`{text}`"), "UTF-8"), 256)


def found_spans(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Spans that a table of patterns finds, for each distinct text that has any: (digest, found as [start, kind, end])."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for digest, content in incoming:
            for start, end in candidates(content, base_spans(content)):
                before = pattern_before(content, start)
                if before:
                    yield digest, start, end, before

    named = texts.select(_digest(text).alias("digest"), F.col(f"`{text}`").alias("text")).where("text RLIKE '[0-9@]'")
    tokens = map_rows(named, rows, "digest string, start int, end int, pattern string").distinct()
    tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("digest", "start"), F.lit(SALTS)))
    salted = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = tokens.join(salted, ["pattern", "salt"])
    return hits.groupBy("digest").agg(F.collect_list(F.array("start", "kind", "end")).alias("found"))


def _with_found(texts: DataFrame, patterns: DataFrame, text: str, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` on the rows with a column ``_found``: what the patterns find in the text, null for nothing."""
    nothing = F.lit(None).cast("array<array<int>>")
    if patterns.isEmpty():
        return use(texts.withColumn("_found", nothing))
    found = stage_table(found_spans(texts, patterns, text), "pii-found").withColumnRenamed("digest", "_digest")
    # Only texts in which something may be found are moved.
    some, others = split(texts.withColumn("_digest", _digest(text)), "_digest", found.select("_digest"))
    joined_ = some.join(found.withColumnRenamed("found", "_found"), "_digest", "left").drop("_digest")
    return use(joined_.unionByName(others.drop("_digest").withColumn("_found", nothing)))


def _merged(base: list[Span], found: list | None) -> list[Span]:
    return base if found is None else sorted(base + [tuple(span) for span in found])


def extract(
    texts: DataFrame, patterns: DataFrame | Mapping[str, int], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per text: its key, counts of base spans, ``base`` and ``spans`` as kind:start:end, comma-joined.

    ``patterns`` is a table (pattern, kind), or a mapping that every worker can hold.
    """
    held = None if isinstance(patterns, DataFrame) else dict(patterns)

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for name, content, found in incoming:
            content = content or ""
            base = base_spans(content)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
            spans = _merged(base, found) if held is None else all_spans(content, held)
            yield (name, *counts, joined(base), joined(spans))

    kind = dict(texts.dtypes)[key]
    numbers = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"`{key}` {kind}, {numbers}, base string, spans string"
    use = lambda rows_: map_rows(rows_.select(key, text, "_found"), rows, schema)
    texts = texts.select(key, text)
    if held is None:
        return _with_found(texts, patterns, text, use)
    return use(texts.withColumn("_found", F.lit(None).cast("array<array<int>>")))


def _redacted(text: str, spans: list[Span]) -> str:
    parts, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact_text(text: str, patterns: Mapping[str, int]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    return _redacted(text, all_spans(text, patterns))


def redact(texts: DataFrame, patterns: DataFrame | Mapping[str, int], text: str = "text") -> DataFrame:
    """The table with personal data in its text replaced; nulls stay null, other columns as they are.

    ``patterns`` is a table (pattern, kind), or a mapping that every worker can hold.
    """
    if not isinstance(patterns, DataFrame):
        held = dict(patterns)

        def clean(content: str | None) -> tuple[str | None]:
            return (None if content is None else redact_text(content, held),)

        return with_changed(sealed(texts, text), ["text"], ["text"], clean).select(*unsealed(texts.columns, text))

    def merged(content: str | None, found: list | None) -> tuple[str | None]:
        return (None if content is None else _redacted(content, _merged(base_spans(content), found)),)

    use = lambda rows: with_changed(rows, ["text", "_found"], ["text"], merged).drop("_found")
    return _with_found(sealed(texts, text), patterns, "text", use).select(*unsealed(texts.columns, text))
