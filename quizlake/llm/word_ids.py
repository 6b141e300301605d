"""Ids of a `tokenizers` vocabulary file, each distinct word once per block of texts.

Both pre-tokenizers in use cut a text into units that look no further than the next white
space, so the ids of a text are the ids of its words in a row. A text with other white space
than single spaces (or single line ends inside words), or with the string of an added token
(`<|endoftext|>`), is encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from quizlake.llm.common import WordRows, text_blocks

KEPT_WORDS = 250_000

# Separators that Python's, Arrow's and the library's ideas of white space differ in.
ODD_SPACE = "[\\x1c-\\x1f\u0085\u180e]"
RUNS = f"[\\s\\p{{Z}}\\x0b]{{2}}|[\\t\\r\\f\\x0b]|[^\\P{{Z}} ]|{ODD_SPACE}"
MARK = "\x01"


class WordIds:
    """Encoder of one vocabulary file: the ids of the library as it is, which adds no special
    tokens but knows their strings in a text. Words new to the memory are encoded together, joined by spaces, and cut
    apart again at tokens that begin with a space, or at a mark between them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = lib = Tokenizer.from_file(path)
        self.by_bytes = lib.normalizer is None
        # Case aside, as a normalizer may change it before the library looks for them.
        added = [re.escape(t.content) for t in lib.get_added_tokens_decoder().values()]
        self.odd = "|".join([RUNS if self.by_bytes else ODD_SPACE, *(f"(?i:{t})" for t in added)])
        if self.by_bytes:
            space = lib.encode(" ", add_special_tokens=False).tokens[0]
            self.cut = np.zeros(lib.get_vocab_size(), bool)
            self.cut[[i for t, i in lib.get_vocab().items() if t.startswith(space)]] = True
        else:
            self.mark = lib.encode(MARK, add_special_tokens=False).ids
            if len(self.mark) != 1:
                raise ValueError("the mark between words must be one token")
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that hold no space, no two white-space characters in a row and no mark."""
        if self.by_bytes:
            lines = [" " + " ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        else:
            lines = [f" {MARK} ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        for line in self.library.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(line.ids, np.int32)
            if self.by_bytes:
                cuts = [*np.flatnonzero(self.cut[ids]).tolist(), len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield ids[a:b].tobytes()
            else:
                cuts = [-1, *np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield ids[a + 1 : b].tobytes()

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, in their order."""
        if len(self.words) > KEPT_WORDS:
            self.words, self.old = {}, self.words
        kept, old = self.words, self.old
        rows: list[bytes | None] = [None] * len(words)
        new = []
        for i, w in enumerate(words):
            ids = kept.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    if w and MARK not in w:
                        new.append(i)
                        continue
                    ids = self.encode(" " + w if self.by_bytes else w)
                if len(w) <= 64:
                    kept[w] = ids
            rows[i] = ids
        for i, ids in zip(new, self._joined([words[i] for i in new]), strict=True):
            rows[i] = ids
            if len(words[i]) <= 64:
                kept[words[i]] = ids
        return rows

    def encode_all(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of an Arrow column."""
        for block in text_blocks(column):
            odd = pc.match_substring_regex(block, self.odd)
            plain = pc.if_else(odd, "", block)
            rows = WordRows(pc.split_pattern(plain, " ") if self.by_bytes else words_between(plain))
            ids = self._ids_of(rows.words)
            if self.by_bytes:  # the first word has no space before it
                rows.replace_first(self.encode, ids)
            texts = rows.ids(ids)
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                texts[i] = np.frombuffer(self.encode(block[i].as_py()), np.int32)
            yield from texts


def words_between(column: pa.Array) -> pa.Array:
    """Words between white space; no empty ones."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(column))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """One encoder, with its memory of words, per Python worker."""
    return WordIds(path)
