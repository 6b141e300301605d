"""Byte codec, quantizer and Merkle manifest against the library and brute force."""

import base64
import hashlib
import random
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quizlake.llm import byte_codec, merkle, quantizer
from quizlake.llm.queries import BYTE_RANKS, QUERIES

PATTERN = public_tokenizers.PATTERN
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, key string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    signs = "aeiou tHE  \n\t▁ñ漢字😀.,;'s're'll(){}*#-—\"0123456789_\x00​é ﬁ//==<|endoftext|>Σσİ²½\x85\x1c\x1f\u180e\u0cdc\U00011de1 "
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    words = ["The", "quick", "fox's", "we'll", "jumps.", "überall", "x" * 90, "1234567", "  ", "\n\n", "<|endoftext|>"]
    made += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    return [*made, None, "", " ", "x" * 3000, "ab" * 2000, "the " * 5000, " " * 900, "\n a\n", "'" * 70, "é" * 50]


def test_classes_of_characters_are_the_library_s():
    """A pre-token of two characters is one token to the library if its pattern keeps both
    together; asked for every character that is not plainly of an old class."""
    split = byte_codec.Splitter(PATTERN, byte_codec.newer_letters(PATTERN))
    kinds = ("Lu", "Ll", "Lo", "Co")
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    chars = [c for i, c in enumerate(chars) if i % 97 == 0 or unicodedata.category(c) not in (*kinds, "Cn") or (unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c))]
    for first in "a1!\n":
        pairs = [first + c for c in chars]
        ranks = {bytes([b]): b for b in range(256)} | {p.encode(): 256 + i for i, p in enumerate(pairs)}
        known = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        theirs = [len(t) == 1 for t in known.encode_ordinary_batch(pairs, num_threads=4)]
        assert [p for p, same in zip(pairs, theirs, strict=True) if same != (len(split(p)) == 1)] == []


@pytest.mark.parametrize("chunk, overlap", [(40, 12), (200, 30), (16_384, 1_024)])
def test_byte_codec_equals_the_library(spark, library, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, (None, "a b", "y"), (None, "c d" * 30, "y"), (3, "again", "z")], "doc_id bigint, text string, ids string")
    got = byte_codec.coded(df, BYTE_RANKS, PATTERN, chunk=chunk, overlap=overlap).collect()
    want = sorted((-1 if r[0] is None else r[0], np.array(library.encode_ordinary(r[1] or ""), np.uint32).tobytes(), (r[1] or "").encode()) for r in df.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_codec.coded(df.limit(0), BYTE_RANKS, PATTERN).count() == 0


def test_very_long_text(spark, library):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60_000)) + "z" * 40_000
    (row,) = byte_codec.coded(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), BYTE_RANKS, PATTERN).collect()
    assert np.frombuffer(row.ids, np.uint32).tolist() == library.encode_ordinary(text) and bytes(row.decoded).decode() == text


def lloyd(vectors, parts=4, entries=256, rounds=4):
    """Every part against every entry, in Python integers."""
    width = -(-max(map(len, vectors)) // parts) * parts
    ints = [[int(np.floor(1024.0 * x)) for x in v] + [0] * (width - len(v)) for v in vectors]
    size = width // parts
    rows = [[v[p * size : (p + 1) * size] for v in ints] for p in range(parts)]
    books = [[list(r) for r in part[:entries]] for part in rows]
    assign = lambda p: [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p])) for x in rows[p]]
    for _ in range(rounds):
        for p in range(parts):
            owner = assign(p)
            for i in range(len(books[p])):
                own = [x for x, (_, o) in zip(rows[p], owner, strict=True) if o == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [assign(p) for p in range(parts)]
    codes = ["".join(f"{last[p][j][1]:02x}" for p in range(parts)) for j in range(len(vectors))]
    errors = [sum(last[p][j][0] for p in range(parts)) for j in range(len(vectors))]
    return codes, errors, ",".join(str(v) for book in books for e in book for v in e)


VECTORS = "vec_id bigint, embedding array<double>, label int, code string"


@pytest.mark.parametrize("case", ["plain", "coarse", "large", "few", "odd"])
def test_quantizer_equals_brute_force(spark, case):
    rng = np.random.default_rng(8)
    n, width = (40, 8) if case == "few" else (700, 8)
    values = rng.normal(size=(n, width))
    if case == "coarse":  # many ties and repeated rows
        values = np.round(values) / 1024
    if case == "large":
        values[:60] *= 3e5
    rows = [(i * 3 - 50, v, None if i % 5 == 0 else i % 3, "x") for i, v in enumerate(values.tolist())]
    if case == "odd":
        rows = [(k, v[: 1 + k % 7], label, c) for k, v, label, c in rows]
    bad = [(-900, None, 1, ""), (-901, [1.0, None], 1, ""), (-902, [float("nan")] * 8, 1, ""), (-903, [float("inf")] * 8, 1, "")]
    df = spark.createDataFrame([*rows, *bad], VECTORS).repartition(3)
    codes = quantizer.fit(df, block_rows=97)
    got = sorted(quantizer.label_errors(codes.rows(), "label").collect())
    want_codes, want_errors, books = lloyd([r[1] for r in rows])
    assert codes.text() == books
    assert [(r.vec_id, r.code, r.error) for r in got] == [(r[0], c, e) for r, c, e in zip(rows, want_codes, want_errors, strict=True)]
    sums = {}
    for r, e in zip(rows, want_errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    assert all(r.label_error == sums[r.label] for r in got)


def test_quantizer_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert quantizer.fit(none).rows().count() == 0 and quantizer.fit(none).text() == ""
    rows = [(None, [1.0, 2.0, 3.0, 4.0], None, ""), (5, [1.0, 2.0, 3.0, 4.0], None, ""), (5, [0.0, 0.0, 0.0, 0.0], 1, "")]
    codes = quantizer.fit(spark.createDataFrame(rows, VECTORS), entries=2)
    got = sorted((r.vec_id is None, r.code, r.error) for r in codes.rows().collect())
    assert got == [(False, "00000000", 0), (False, "01010101", 0), (True, "01010101", 0)]
    assert codes.vectors(np.array([[1, 1, 1, 1]])).tolist() == [[1024, 2048, 3072, 4096]]
    with pytest.raises(Exception, match="64 bits"):
        quantizer.fit(spark.createDataFrame([(1, [1e300] * 4, 1, "")], VECTORS))


def test_moved_entries_alone_give_the_same_codes():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, books = rng.integers(-3, 4, (80, 2)), rng.integers(-3, 4, (9, 2))
        code, far = quantizer.nearest(x, books)
        new = np.where(rng.random((9, 1)) < 0.3, rng.integers(-3, 4, (9, 2)), books)
        again = quantizer.reassign(x, new, (new != books).any(1), code, far)
        want = quantizer.nearest(x, new)
        assert again[0].tolist() == want[0].tolist() and again[1].tolist() == want[1].tolist()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """The root of a list of digests and the siblings of each, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for j, i in enumerate(at):
            run = i // 16 * 16
            paths[j].append((level[run:i], level[i + 1 : run + 16]))
        level, at = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], [i // 16 for i in at]
    return level[0], paths


def manifest(rows):
    leaf = lambda r, text: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = climb([leaf(r, r[1]) for r in groups[s]])
    root, upper = climb([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            path = path + upper[k]
            bad = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, "".join(c.lower() if c.isascii() else c for c in r[1]) if bad else r[1])
            for before, after in path:
                fold = h(*before, fold, *after)
            siblings = h(*[x for before, after in path for x in before + after])
            out.append((r[0] is None, r[0] or 0, leaf(r, r[1]), trees[s][0], root, siblings, fold, fold == root))
    return sorted(out)


@pytest.mark.parametrize("sizes", [[1], [16, 1, 17], [700, 257, 256, 3], [1] * 300])
def test_merkle_equals_brute_force(spark, tmp_path, sizes):
    rng = random.Random(2)
    rows = []
    for s, n in enumerate(sizes):
        source = None if s == 1 else rng.choice(["é", "src", "ſ", "z"]) + str(s) if s else ""
        for _ in range(n):
            k = rng.randint(-10**6, 10**12)
            rows.append((k, rng.choice(["A Text", "lower", "", None, "ÀÉ Big 漢"]), rng.choice(["en", None]), source, rng.choice([None, 5]), 1, "c"))
    if len(rows) > 10:
        rows += [rows[0], rows[0], (None, "Null", None, rows[3][3], 4, 1, "c"), (rows[5][0], "Other", None, rows[5][3], 4, 1, "c")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op13_merkle"](spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in got) == manifest(rows)


def test_merkle_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), ["doc_id", "text"]).count() == 0


def test_merkle_levels_stay_fixed_width_strings(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rows = merkle.manifest(df, ["doc_id"]).collect()
    assert all(len(s.before) % 64 == 0 and len(s.before) + len(s.after) <= 15 * 64 for r in rows for s in r.path)
