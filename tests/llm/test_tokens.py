import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quizlake.llm import packing, piece_codec, token_files
from quizlake.llm.common import scratch, stored
from quizlake.llm.queries import BYTE_VOCABULARY, PIECE_MODEL, QUERIES, WORD_VOCABULARY
from quizlake.llm.word_ids import word_ids

SIGNS = "aeiou tHE  \n\t▁ñ漢字😀.,;(){}*#-—''\"0123456789_\x00​é ﬁ//==<>s>unkΣσİ²½\x85\x1c\x01"


def texts() -> list[str | None]:
    rng = random.Random(3)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    words = ["The", "quick", "brown", "fox's", "jumps.", "überall", "naïve", "x" * 90, "1234567", "<s>", "<|endoftext|>"]
    made += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return [*made, None, "", " ", "  ", "a ", " a", "x" * 6000, "ab" * 4000, "the " * 20000, " " * 3000, "\n a\n"]


def test_piece_codec_equals_the_library():
    codec = piece_codec.codec(PIECE_MODEL)
    for text, ids in zip(texts(), codec.encode_all(pa.array(texts(), pa.string())), strict=True):
        want = list(codec.library.encode(text or "", add_eos=True))
        assert ids.tolist() == want, text
        assert codec.encode(text or "").tolist() == want


def test_piece_codec_columns(spark):
    rows = [(i, t, i) for i, t in enumerate(texts()[-20:])]
    df = spark.createDataFrame([*rows, (None, "a b", 0)], "doc_id bigint, text string, ids int")
    lib = piece_codec.library(PIECE_MODEL)
    for r in piece_codec.coded(df, PIECE_MODEL).collect():
        text = "a b" if r.doc_id is None else rows[r.doc_id][1] or ""
        assert r.ids == list(lib.encode(text, add_eos=True)) and r.decoded == lib.decode(r.ids)
    both = piece_codec.encoded(df, PIECE_MODEL, name="n").select("n", piece_codec.decoded(F.col("n"), PIECE_MODEL).alias("t"))
    assert all(r.t == lib.decode(r.n) for r in both.collect())
    assert piece_codec.coded(df.limit(0), PIECE_MODEL).count() == 0


@pytest.mark.parametrize("path", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_word_ids_equal_the_library(path):
    encoder = word_ids(path)
    column = pa.array(texts(), pa.string())
    for _ in range(2):  # from memory the second time
        for text, ids in zip(texts(), encoder.encode_all(column), strict=True):
            assert ids.tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids, text


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.pack(v)
        assert len(control) == (n + 3) // 4
        assert token_files.unpack(control, data, n).tolist() == v.tolist()
    rows = [np.array([1, 300, 70000, 2**31], np.uint32), np.zeros(0, np.uint32)]
    keys, back = token_files.read_file(token_files.file_bytes([None, -5], rows))
    assert keys == [None, -5] and [b.tolist() for b in back] == [r.tolist() for r in rows]


@pytest.mark.parametrize("file_ids", [50, 10**6])
def test_token_files_round_trip(spark, file_ids):
    some = texts()[-40:]
    df = spark.createDataFrame([(i * 7 - 50, t, "x") for i, t in enumerate(some)], "doc_id bigint, text string, start string")
    path = scratch(spark, "tokens")
    ids = stored(token_files.token_ids(df.repartition(5), WORD_VOCABULARY, end_id=1), "ids")
    size = word_ids(WORD_VOCABULARY).library.get_vocab_size()
    manifest = token_files.write_files(ids, path, size, file_ids=file_ids)
    got = sorted(token_files.read_files(spark, path, manifest).collect())
    start = 0
    for r, text in zip(got, some, strict=True):
        want = [*word_ids(WORD_VOCABULARY).library.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(r.ids, np.uint32).tolist() == want and r.start == start
        start += len(want)


def test_token_files_of_no_documents(spark):
    path = scratch(spark, "tokens")
    df = spark.createDataFrame([], "doc_id bigint, text string")
    ids = stored(token_files.token_ids(df, WORD_VOCABULARY, end_id=1), "ids")
    manifest = token_files.write_files(ids, path, 49408)
    assert manifest.count() == 0


def test_token_file_query_of_no_documents_and_of_repeated_ids(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op10_token_files"](spark, f"{tmp_path}/none").count() == 0
    rows = [(k, t, "en", "s", 1) for k in (5, 5, 5, None, None, 2) for t in ("one", "two words", "one", "and three more")]
    results = []
    for n, parts in enumerate((1, 7)):
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = QUERIES["op10_token_files"](spark, f"{tmp_path}/{n}").collect()
        results.append(sorted((r.start, r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    starts = [r[0] for r in results[0]]
    assert starts == [0, *np.cumsum([r[3] for r in results[0]])[:-1].tolist()]
    assert [r[1:3] for r in results[0]] == [(True, 0)] * 8 + [(False, 2)] * 4 + [(False, 5)] * 12


def test_pieces_and_packing(spark):
    some = [t or "" for t in texts()[-300:]]
    df = spark.createDataFrame([(i, t or None, 0) for i, t in enumerate(some)] + [(None, "no key", 0)], "doc_id bigint, text string, length int")
    cut = stored(packing.pieces(df.repartition(4), BYTE_VOCABULARY, end_id=2), "cut")
    packed = packing.placed(cut).collect()
    lib = word_ids(BYTE_VOCABULARY).library
    for i, t in enumerate(some):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], np.uint32)
        mine = sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in packed if r.doc_id == i)
        assert b"".join(m[3] for m in mine) == ids.tobytes()
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert all(m[2] == 1024 for m in mine[1:]) and sum(m[2] for m in mine) == len(ids)
        assert zlib.crc32(b"".join(m[3] for m in mine)) == zlib.crc32(ids.tobytes())
    check_places([(r.sequence_id, r.offset, r.length) for r in packed], 1024)
    glued = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.placed(cut)).collect()}
    for r in packed:
        assert glued[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def check_places(rows, capacity) -> int:
    ends: dict[int, int] = {}
    for sequence, offset, length in sorted(rows):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values(), default=0) <= capacity
    return len(ends)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.0, 4000).astype(int), 1, 1024)
    n, c = np.unique(lengths, return_counts=True)
    rows = packing.plan(dict(zip(n.tolist(), c.tolist(), strict=True)))
    places, large = [], {}
    for length, _, bins, each, sequence, offset in rows.tolist():
        for b in range(bins):
            for k in range(each):
                places.append((sequence + b, offset + k * length, length))
                if 3 * length > 1024:
                    large[sequence + b] = large.get(sequence + b, 0) + 1
    assert sorted(p[2] for p in places) == sorted(lengths.tolist()) and max(large.values()) <= 2
    assert check_places(places, 1024) <= 1.02 * lengths.sum() / 1024 + 2
    assert len(packing.plan({})) == 0


@pytest.mark.parametrize("path", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_strings_of_added_tokens_as_in_a_fresh_library(path):
    some = ["a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|>", "a <|STARTOFTEXT|> B", "<|endoftext|", "plain words", None]
    fresh = Tokenizer.from_file(path)
    for text, ids in zip(some, word_ids(path).encode_all(pa.array(some, pa.string())), strict=True):
        assert ids.tolist() == fresh.encode(text or "", add_special_tokens=False).ids, text
    assert fresh.get_vocab()["<|endoftext|>"] in next(word_ids(path).encode_all(pa.array(some[:1]))).tolist()
