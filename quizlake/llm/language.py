"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each of its slots is a mask with a bit per language
(the filters of all languages, bit-sliced), so a look-up of an n-gram in three slots, and-ed,
returns every language that holds it. A text's n-grams are looked up once; per language the
hits are counted, hits that the filter's fill makes up are taken off, and the most hits decide.

A language holds an n-gram if at least `share` of its sampled texts do. The sample is at most
`per_language` texts per language, picked by a hash of their key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import text_blocks
from quizlake.operators.ranking import top_n

GRAM, SLOT_BITS, LOOKUPS = 4, 21, 3
PER_LANGUAGE, SHARE = 1500, 0.02
BLOCK = 1 << 20
NONE = "und"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all letter n-grams of `texts`, the number of the text each belongs to, and
    whether a text has a letter. Case is folded; what lies between letters is one space."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    text = np.repeat(np.arange(len(low), dtype=np.int32), sizes + 1)
    letter = letters()[code]
    some = np.zeros(len(low), bool)
    some[text[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    text = text[keep]
    n = max(0, len(code) - GRAM + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(GRAM):
        mixed += code[i : i + n] * MULTIPLIERS[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= MULTIPLIERS[0]
    mixed ^= mixed >> np.uint64(29)
    whole = text[:n] == text[GRAM - 1 :] if n else np.zeros(0, bool)
    return mixed[whole], text[:n][whole], some


def slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(LOOKUPS):
        yield (hashes >> np.uint64(i * SLOT_BITS) & np.uint64(2**SLOT_BITS - 1)).astype(np.int64)


@dataclass
class Filter:
    """The learned languages, most sampled texts first, and the masks of all slots."""

    languages: list[str]
    masks: np.ndarray

    def chance(self) -> np.ndarray:
        """Per language, how often an n-gram it does not hold is reported."""
        bits = np.array([((self.masks >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        return bits**LOOKUPS

    def predict(self, texts: list[str], chance: np.ndarray) -> tuple[list[str], np.ndarray]:
        return self.judge(texts, chance)[:2]

    def judge(self, texts: list[str], chance: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and number of n-grams of every text."""
        hashes, text, some = grams(texts)
        mask = np.full(len(hashes), np.uint64(2**64 - 1))
        for slot in slots(hashes):
            mask &= self.masks[slot]
        total = np.bincount(text, minlength=len(texts))
        hits = np.stack(
            [np.bincount(text[(mask >> np.uint64(i)) & np.uint64(1) == 1], minlength=len(texts))
             for i in range(len(self.languages))]
        )
        real = np.clip((hits - total * chance[:, None]) / (1 - chance[:, None]), 0, None)
        best = real.argmax(0)  # ties: the language with more sampled texts
        score = np.where(total > 0, real.max(0) / np.maximum(total, 1), 0.0)
        names = [self.languages[b] if s else NONE for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return names, np.where(some, np.clip(score, 0, 1), 0.0), total


def learn(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    share: float = SHARE,
) -> Filter:
    """The filter of the languages of `docs`; rows with null text or language teach nothing.

    At most `per_language` texts per language (and 64 languages) reach the count, and an
    n-gram counts from `share` of them on, so what the driver gets has a fixed bound."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    named = known.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"))
    order = [F.xxhash64("_key"), F.col("_key")]
    chosen = top_n(named, ["_lang"], order, per_language, F.col("_key")).select("_key").distinct()
    sample = known.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("_key")), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[name] = texts.get(name, 0) + 1
                found.setdefault(name, []).append(np.unique(grams([row])[0]))
        for name, rows in found.items():
            gram, n = np.unique(np.concatenate(rows), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(gram) + 1)),
                 pa.array([None, *gram.view(np.int64).tolist()], pa.int64()),
                 pa.array([texts[name], *n.tolist()], pa.int64())],
                names=["lang", "gram", "n"],
            )

    counted = sample.select(lang, text).mapInArrow(count, "lang string, gram bigint, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    size = counted.filter("gram is null").select(F.col("lang").alias("_lang"), F.col("n").alias("_texts"))
    held = counted.join(F.broadcast(size), F.col("lang") == F.col("_lang"))
    held = held.filter((F.col("n") >= F.col("_texts") * share) & ((F.col("n") >= 2) | (F.col("_texts") < 50)))
    rows = held.groupBy("lang").agg(F.max("_texts").alias("texts"), F.collect_list("gram").alias("grams")).collect()
    if len(rows) > 64:
        raise ValueError("a mask holds 64 languages")
    rows.sort(key=lambda r: (-r["texts"], r["lang"]))
    masks = np.zeros(2**SLOT_BITS, np.uint64)
    for i, r in enumerate(rows):
        hashes = np.array(r["grams"], np.int64).view(np.uint64)
        for slot in slots(hashes):
            masks[slot] |= np.uint64(1 << i)
    return Filter([r["lang"] for r in rows], masks)


def predicted(docs: DataFrame, known: Filter, text: str = "text") -> Column:
    """Struct (lang, score, grams) of every whole text: a learned language, or `und` if the text is
    null, has no letter, or nothing was learned. The score is the share of the text's n-grams
    that the language holds, between 0 and 1; `grams` is the number of the text's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast((known, known.chance()))

    @F.arrow_udf("struct<lang: string, score: double, grams: bigint>")
    def predict(column: pa.Array) -> pa.Array:
        filters, chance = shared.value
        names: list[str] = []
        scores: list[np.ndarray] = [np.zeros(0)]
        sizes: list[np.ndarray] = [np.zeros(0, np.int64)]
        for block in text_blocks(column, BLOCK):
            texts = block.to_pylist()
            if not filters.languages:
                names += [NONE] * len(texts)
                scores.append(np.zeros(len(texts)))
                sizes.append(np.zeros(len(texts), np.int64))
                continue
            some, score, size = filters.judge(texts, chance)
            names += some
            scores.append(score)
            sizes.append(size)
        columns = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(sizes), pa.int64())]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "grams"])

    return predict(F.col(text))
