"""Token counts of a sentencepiece BPE model without encoding whole texts.

Two facts are proved from the model file before any text is read:

* no piece holds the space mark after another character, so no merge crosses the place before a run of
  spaces, and the pre-tokens (a run of spaces with what follows it) can be counted one by one;
* which vocabulary strings encode alone as one token. A pre-token that is such a string counts one.

Only the other pre-tokens are merged by the library, and a worker remembers a bounded number of them. A model
for which the first fact does not hold is refused.

Nulls are read as empty texts with no tokens. Texts of any length are counted whole; repeated rows give repeated
results; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Iterator

from pyspark.sql import DataFrame

from forewarn.llm.common import forget_after, map_rows

MARK = "▁"
REMEMBERED = 200_000


class TokenCounter:
    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        if self._model.encode("a  b\n", out_type=str)[:1] not in ([MARK + "a"], [MARK]):
            raise ValueError("the model must put a space mark before a text")
        if self._model.normalize("a  Åﬁ ") != MARK + "a" + MARK * 2 + "Åﬁ" + MARK:
            raise ValueError("the model must not normalise texts")
        pieces = [
            self._model.id_to_piece(i)
            for i in range(self._model.vocab_size())
            if not (self._model.is_control(i) or self._model.is_unknown(i) or self._model.is_byte(i))
        ]
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece crosses a word border; words can't be counted one by one")
        #: Newlines are cut out as one byte token each if no piece holds them.
        self._lines = not any("\n" in piece for piece in pieces)
        #: Tokens of the mark alone, which the library can't be asked for.
        self._mark = 1 if MARK in pieces else len(MARK.encode())
        self.whole = self._prove(pieces)
        self._known: dict[str, int] = {}

    def _count(self, pretokens: list[str]) -> list[int]:
        """Merge pre-tokens; each begins with the space mark, which the library adds by itself."""
        counts = [len(ids) for ids in self._model.encode([p[1:] for p in pretokens], num_threads=1)]
        return [n if p != MARK else self._mark for n, p in zip(counts, pretokens)]

    def _prove(self, pieces: list[str]) -> frozenset[str]:
        """The vocabulary strings that are one token when they stand alone.

        The library always puts the mark in front, so this can be shown for strings that begin with it;
        only these are pre-tokens.
        """
        marked = [piece for piece in pieces if piece.startswith(MARK)]
        return frozenset(piece for piece, n in zip(marked, self._count(marked)) if n == 1)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self._lines and "\n" in text:
            # A newline is its byte token, and nothing merges across it; what follows it has no mark of its own.
            first, *rest = text.split("\n")
            head = self._marked(first) if first else 1
            return head + len(rest) + sum(self._bare(part) for part in rest if part)
        return self._marked(text)

    def _marked(self, text: str) -> int:
        return self._words(_cut(MARK + text.replace(" ", MARK)))

    def _bare(self, text: str) -> int:
        """Tokens of a text that stands after a newline: its first pre-token has no mark in front."""
        text = text.replace(" ", MARK)
        if text[0] == MARK:
            return self._words(_cut(text))
        word, mark, rest = text.partition(MARK)
        after_line = self._after_line(word)
        return after_line + (self._words(_cut(mark + rest)) if mark else 0)

    def _after_line(self, word: str) -> int:
        """A word without a mark: behind a newline, whose token and mark are then taken off."""
        key = "\n" + word
        n = self._known.get(key)
        if n is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            n = self._known[key] = len(self._model.encode(key)) - 2
        return n

    def _words(self, pretokens: list[str]) -> int:
        known = self._known
        step = REMEMBERED // 2
        if len(pretokens) > step:
            return sum(self._words(pretokens[i : i + step]) for i in range(0, len(pretokens), step))
        try:
            return sum(map(known.__getitem__, pretokens))
        except KeyError:
            unseen = set(pretokens).difference(known)
        if len(known) + len(unseen) > REMEMBERED:
            known.clear()
            unseen = set(pretokens)
        direct = unseen & self.whole
        known.update(dict.fromkeys(direct, 1))
        rest = list(unseen - direct)
        known.update(zip(rest, self._count(rest)))
        return sum(map(known.__getitem__, pretokens))


_cut = re.compile(f"{MARK}+[^{MARK}]*").findall


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


forget_after(counter.cache_clear)


def count_tokens(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its key, ``n_bytes`` (UTF-8) and ``n_tokens``, without begin and end tokens."""

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        tokens = counter(path)
        for name, content in incoming:
            content = content or ""
            yield name, len(content.encode()), tokens.count(content)

    kind = dict(texts.dtypes)[key]
    return map_rows(texts.select(key, text), rows, f"`{key}` {kind}, n_bytes long, n_tokens long")
