"""Merge-type piece encoding by backtracking, and decoding.

A merge-type encoding is decided by its neighbours: a row of tokens is *the* encoding when
each token encodes to itself and each two adjacent tokens, merged again from their
characters, come back as these two. So a text is read from the left with the longest tokens
that an Aho-Corasick automaton finds; a token is taken if it is compatible with the one
before it, else the next shorter prefix token is tried; if none is left the place is marked
in a bit field as failed and the last token is given up. Each place fails at most once, so
the work is linear in the text.

No piece of the vocabulary holds a space mark after another character, so words are encoded
apart and remembered; a character outside the vocabulary never merges and becomes its bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import WordCache, WordRows, int_lists, paused_gc, text_blocks

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def parts_of(pieces: list[str]) -> re.Pattern:
    """Pattern of the parts that no piece spans: runs of letters and digits, runs of other
    signs. Letter-like characters that share a piece with a sign count as signs; if that
    does not part the pieces, words stay whole."""
    signs = "_"
    for _ in range(2):
        word = re.compile(f"[^\\W{re.escape(signs)}]")
        mixed = {
            c
            for p in pieces
            for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:], strict=False)
            if bool(word.match(a)) != bool(word.match(b))
            for c in (a, b)
            if word.match(c)
        }
        if not mixed:
            letters, others = f"[^\\W{re.escape(signs)}]", f"(?:[^\\w{SPACE}]|[{re.escape(signs)}])"
            return re.compile(f"{SPACE}*{letters}+|{SPACE}*{others}+|{SPACE}+")
        signs += "".join(sorted(mixed))
    return UNITS


class PieceCodec:
    """Encoder of one model file; the library is used for the vocabulary and for `decode`."""

    def __init__(self, model: str):
        self.library = lib = library(model)
        self.end = lib.eos_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece], self.score[piece] = i, lib.get_score(i)
        pieces = list(self.ids)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans words: this vocabulary cannot be encoded word by word")
        self.parts = parts_of(pieces)
        # Tokens that their own characters do not merge to can never be produced.
        self.tokens = {p for p in pieces if len(p) == 1 or self._merged(p) == [p]}
        self.find = ahocorasick.Automaton()
        for p in self.tokens:
            self.find.add_word(p, len(p))
        self.find.make_automaton()
        chars = "".join(re.escape(t) for t in self.tokens if len(t) == 1)
        self.known_runs = re.compile(f"([{chars}]+)|([^{chars}])", re.S).findall
        self.compatible = lru_cache(1 << 18)(lambda a, b: self._merged(a + b) == [a, b])
        self.part_cache = WordCache(self._encode_part, 250_000)
        self.words = WordCache(self._encode_word, 120_000)

    def _merged(self, chars: str) -> list[str]:
        """Merge neighbours, best score first, leftmost among equals."""
        row, score = list(chars), self.score
        while len(row) > 1:
            best, at = None, -1
            for i in range(len(row) - 1):
                s = score.get(row[i] + row[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            row[at : at + 2] = [row[at] + row[at + 1]]
        return row

    def _known(self, text: str) -> list[str]:
        """Tokens of a text whose characters are all in the vocabulary."""
        n = len(text)
        ends: list[list[int]] = [[] for _ in text]
        for last, size in self.find.iter(text):  # by end, so ends rise per start
            ends[last + 1 - size].append(last + 1)
        row: list[str] = []
        left: list[list[int]] = []  # per token, the ends of its shorter prefixes
        failed = bytearray(n + 1)
        at, todo, before = 0, ends[0], None
        compatible = self.compatible
        while at < n:
            while todo:
                end = todo.pop()
                token = text[at:end]
                if not failed[end] and (before is None or compatible(before, token)):
                    row.append(token)
                    left.append(todo)
                    at, before = end, token
                    todo = ends[end] if end < n else []
                    break
            else:
                failed[at] = 1  # so the tokens that end here are given up for good
                at -= len(row.pop())
                todo = left.pop()
                before = row[-1] if row else None
        return row

    def _encode_part(self, part: str) -> bytes:
        out = array("i")
        for run, other in self.known_runs(part):
            if run:
                out.extend(self.ids[t] for t in self._known(run))
            else:
                out.extend(self.bytes[b] for b in other.encode("utf-8", "replace"))
        return out.tobytes()

    def _encode_word(self, word: str) -> bytes:
        cache = self.part_cache
        return b"".join([cache[p] for p in self.parts.findall(word)])

    def encode(self, text: str, end: bool = True) -> array:
        """Ids of the whole text; the empty text has no id but the end id."""
        ids = array("i")
        if text:
            marked = text.replace(" ", SPACE)
            if SPACE * 2 in marked or marked[0] == SPACE or marked[-1] == SPACE:
                units = UNITS.findall(SPACE + marked)
                ids.frombytes(b"".join(map(self.words.__getitem__, units)))
            else:
                cache = self.words
                ids.frombytes(b"".join([cache[SPACE + w] for w in marked.split(SPACE)]))
        if end:
            ids.append(self.end)
        return ids

    def encode_all(self, column: pa.Array, end: bool = True) -> Iterator[np.ndarray]:
        """Ids of every text of an Arrow column; each distinct word of a block is looked up once."""
        tail = np.array([self.end] if end else [], np.int32)
        for block in text_blocks(column):
            marked = pc.replace_substring(block, " ", SPACE)
            odd = pc.match_substring_regex(marked, f"^{SPACE}|{SPACE}{SPACE}|{SPACE}$|^$").to_numpy(zero_copy_only=False)
            rows = WordRows(pc.split_pattern(pc.if_else(pa.array(odd), "", marked), SPACE))
            words = self.words
            ids = rows.ids([words[SPACE + w] for w in rows.words])
            for i in np.flatnonzero(odd).tolist():
                ids[i] = np.array(self.encode(block[i].as_py(), end=False), np.int32)
            for row in ids:
                yield np.concatenate([row, tail])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, by the library; control ids such as the end id give nothing."""
        return self.library.decode(ids)


@lru_cache(2)
def codec(model: str) -> PieceCodec:
    """One codec, with its caches, per Python worker."""
    return PieceCodec(model)


@lru_cache(2)
def library(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def coded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, ids (end id included) and decoded text of every whole text, in one pass.

    Null text counts as empty: it gives the end id alone and decodes to the empty text.
    Texts go through in blocks of a few megabytes, which bounds a worker's memory.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column(1), 4 << 20):
                with paused_gc():
                    ids = list(c.encode_all(block))
                    back = [c.decode(row.tolist()) for row in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), int_lists(ids), pa.array(back, pa.string())],
                    names=[key, "ids", "decoded"],
                )
                at += len(block)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, ids array<int>, decoded string")


def encoded(docs: DataFrame, model: str, text: str = "text", name: str = "ids") -> DataFrame:
    """`docs` with an array of ids (end id included) of every whole text; null text counts as
    empty. Other columns stay as they are."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        c = codec(model)
        with paused_gc():
            return int_lists(list(c.encode_all(column)))

    return docs.withColumn(name, encode(F.col(text)))


def decoded(ids: Column, model: str) -> Column:
    """The text that an array of ids stands for; null ids give null."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        lib = library(model)
        return pa.array([None if r is None else lib.decode(r) for r in column.to_pylist()], pa.string())

    return decode(ids)
