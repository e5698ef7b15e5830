"""Byte-level BPE run by a sentencepiece model that is written here from a rank file.

Each byte becomes one character, each vocabulary string of bytes one piece of such characters with the
negative rank as its score, so that the best-scored merge of sentencepiece is the lowest-ranked merge of
the rank file. The model has no normalisation, no added space and one unused unknown piece after the last
rank. Texts are cut by the split pattern first; every match is encoded separately.

Nulls are read as empty texts and give no ids. Texts of any length are encoded whole; repeated rows give
repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from typing import Iterator

from pyspark.sql import DataFrame

from forewarn.llm.common import map_rows

# Stretches, and pre-tokens, a worker remembers; emptied when full, so its memory is bounded.
REMEMBERED = 200_000


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file (base64 of the bytes, then the rank), by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def as_characters(data: bytes) -> str:
    """One character for each byte, none of them a space or a character that sentencepiece treats specially."""
    return data.decode("latin-1").translate(_SHIFT)


_SHIFT = {byte: 0x100 + byte for byte in range(256)}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model (protocol buffer) whose piece ``i`` is the vocabulary string of rank ``i``."""
    model = bytearray()
    for rank, token in enumerate(vocabulary):
        piece = _message(1, as_characters(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        model += _message(1, piece)
    unknown = _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)
    model += _message(1, unknown)
    bpe = 2
    trainer = _number(3, bpe) + _number(4, len(vocabulary) + 1) + _number(40, len(vocabulary))
    no_bos = no_eos = no_pad = (1 << 64) - 1
    trainer += _number(41, no_bos) + _number(42, no_eos) + _number(43, no_pad)
    model += _message(2, trainer)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    model += _message(3, normaliser)
    return bytes(model)


class ByteBpe:
    """Encoder and decoder of one rank file; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = read_ranks(path)
        self._split = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.vocabulary))
        self._whole = {token: struct.pack("<I", rank) for rank, token in enumerate(self.vocabulary)}
        self._spaced = regex.compile(r"\s ").search
        self._pretokens: dict[str, bytes] = {}
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """A space behind anything but white space begins a pre-token, so texts are remembered by such stretches."""
        if self._spaced(text):
            return self._joined(self._split(text))
        first, *words = text.split(" ")
        return self._joined(self._split(first)) + self._joined(words, " ")

    def _joined(self, parts: list[str], before: str = "") -> bytes:
        known = self._known if before else self._pretokens
        step = REMEMBERED // 2
        if len(parts) > step:
            return b"".join(self._joined(parts[i : i + step], before) for i in range(0, len(parts), step))
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            unseen = set(parts).difference(known)
        if len(known) + len(unseen) > REMEMBERED:
            known.clear()
            unseen = set(parts)
        if before:
            cut = [(part, self._split(before + part)) for part in unseen]
            self._joined([pretoken for _, pretokens in cut for pretoken in pretokens])
            known.update((part, self._joined(pretokens)) for part, pretokens in cut)
        else:
            self._learn(unseen)
        return b"".join(map(known.__getitem__, parts))

    def _learn(self, pretokens: set[str]) -> None:
        """Encode unseen pre-tokens; one that is a vocabulary string as a whole is that id, as in the library."""
        merged = []
        for pretoken in pretokens:
            packed = self._whole.get(pretoken.encode())
            if packed is None:
                merged.append(pretoken)
            else:
                self._pretokens[pretoken] = packed
        for pretoken, ids in zip(merged, self._model.encode([as_characters(t.encode()) for t in merged], num_threads=1)):
            self._pretokens[pretoken] = struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, packed: bytes) -> bytes:
        ids = memoryview(packed).cast("I")
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(texts: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its key and ``ids`` (binary, little-endian unsigned 32-bit integers)."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        bpe = coder(path, pattern)
        for name, content in incoming:
            yield name, bpe.encode(content or "")

    kind = dict(texts.dtypes)[key]
    return map_rows(texts.select(key, text), rows, f"`{key}` {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """The encoded rows with ``decoded``, the bytes that the ids stand for."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        bpe = coder(path, pattern)
        for name, ids in incoming:
            yield name, ids, bpe.decode(ids or b"")

    kind = dict(encoded.dtypes)[key]
    return map_rows(encoded.select(key, "ids"), rows, f"`{key}` {kind}, ids binary, decoded binary")
