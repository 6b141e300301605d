import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quizlake.llm import language, near_texts, suffixes, toxicity

ENGLISH = "the and that with this from have were which their would there about people other because through".split()
GERMAN = "und der die das nicht sich auch eine werden zwischen während über könnten mußte straße welche durch".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, GERMAN if i % 3 == 0 else ENGLISH, rng.randint(4, 60)), "de" if i % 3 == 0 else "en") for i in range(300)]
    known = language.learn(spark.createDataFrame(rows[:200] + [(900, None, "fr"), (901, "x", None)], "doc_id bigint, text string, lang string"))
    assert sorted(known.languages) == ["de", "en"]
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 34 !!", None), (503, "ok", None), (None, "DIE STRASSE UND DER", None)]
    df = spark.createDataFrame(rows[200:] + odd, "doc_id bigint, text string, score string")
    got = {r.doc_id: r.l for r in df.select("doc_id", language.predicted(df, known).alias("l")).collect()}
    assert all(got[d].lang == lang and 0 < got[d].score <= 1 for d, _, lang in rows[200:])
    assert all(got[d].lang == "und" and got[d].score == 0 for d in (500, 501, 502))
    assert got[503].lang == "en" and got[None].lang == "de"  # no n-gram known: the commonest language
    none = language.learn(df.limit(0).withColumn("lang", F.lit("x")))
    assert {r.l.lang for r in df.select(language.predicted(df, none).alias("l")).collect()} == {"und"}


def test_filter_reports_all_languages_of_a_gram():
    masks = np.zeros(2**language.SLOT_BITS, np.uint64)
    hashes, _, _ = language.grams(["shared words", "only here"])
    for bit, part in ((0, hashes), (1, hashes[:5])):
        for slot in language.slots(part):
            masks[slot] |= np.uint64(1 << bit)
    f = language.Filter(["a", "b"], masks)
    names, score = f.predict(["shared words only here"], f.chance())
    assert names == ["a"] and score[0] > 0.8


def test_toxicity_chain(spark):
    rng = random.Random(2)
    bad, rows, labels = ["vile", "rotten", "filthy"], [], []
    for i in range(600):
        toxic, poor = i % 5 == 0, i % 7 == 0
        words = prose(rng, ENGLISH, 30).split() + [rng.choice(bad)] * (2 * toxic) + ["zzz"] * (3 * poor)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        if i < 500:
            labels.append((i, int(poor), int(toxic)))
    labels += [(1, None, 1), (None, 0, 0), (9999, 0, 1)]
    docs = spark.createDataFrame([*rows, (700, None, "x"), (701, "", "x"), (None, "vile vile", "x")], "doc_id bigint, text string, _key string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, poor int, toxic int"), ["poor", "toxic"])
    got = {r.doc_id: r for r in chain.score(docs).collect()}
    for i, text, _ in rows[500:]:
        assert (got[i]["_p_toxic"] >= 0.5) == (i % 5 == 0), text
        assert (got[i]["_p_poor"] >= 0.5) == (i % 7 == 0)
    assert got[700]["_p_toxic"] == got[701]["_p_toxic"] < 0.5 <= got[None]["_p_toxic"]
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, poor int, toxic int"), ["poor", "toxic"])
    assert {r["_p_toxic"] for r in none.score(docs).collect()} == {0.0}


def corpus(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwyzäé") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    made = [prose(rng, words, rng.randint(0, 250)) for _ in range(60)]
    passage = prose(rng, words, 110)
    for i in range(0, 30, 2):  # a passage in many documents, whole or in part
        cut = rng.randint(0, 200) if i % 4 else 0
        made[i] = made[i][:300] + " " + passage[cut:] + " " + made[i][300:]
    made += [made[40], made[40], made[41] + " tail", "x" * 3000, "x" * 500, "ab" * 400, "abcde" * 200, None, "", "é" * 300]
    for k in range(12):  # near copies
        w = made[42 + k % 2].split() if made[42 + k % 2] else ["a"]
        w[rng.randrange(len(w))] = "changed"
        made.append(" ".join(w))
    return [*made, "one two three", "one two three", "One, two: three!"]


@pytest.mark.parametrize("seed, batches", [(1, 4), (2, 1), (3, 7)])
def test_long_repeats_equal_brute_force(spark, seed, batches):
    texts = corpus(seed)
    df = spark.createDataFrame([(i * 3, t, 0) for i, t in enumerate(texts)] + [(None, texts[40], 0)], "doc_id bigint, text string, doc int")
    got = {r.doc_id // 3: r for r in suffixes.deduplicated(df.repartition(3), batches).collect()}
    data = [(t or "").encode() for t in texts]
    n = suffixes.LEAST
    counts: dict[bytes, int] = {}
    for b in data:
        for p in range(len(b) - n + 1):
            counts[b[p : p + n]] = counts.get(b[p : p + n], 0) + 1
    removed = 0
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if counts[b[p : p + n]] > 1:
                gone[p : p + n] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        assert got[i].spans == edge.tolist(), i
        assert bytes(got[i].kept) == bytes(np.frombuffer(b, np.uint8)[~gone]) and got[i].n_bytes == len(b)
        removed += int(gone.sum())
    assert removed > 5000 and len(got) == len(texts)
    assert suffixes.deduplicated(df.limit(0)).count() == 0


def test_family_levels_grow_geometrically(spark):
    rng = random.Random(5)
    entries = [(1, bytes(rng.choice(b"ab") for _ in range(12)), i, 0) for i in range(160)]
    family = suffixes.SuffixFamily()
    for b in range(5):
        rows = entries[b * 32 : b * 32 + 32]
        family.add(spark.createDataFrame(rows, "key bigint, context binary, doc bigint, pos int").repartition(2))
    assert sorted(family.levels) == [0, 2] and family.levels[2].count() == 128
    got = {r.doc: r.common for r in family.longest().collect()}
    for _, c, d, _ in entries:
        common = [next((i for i, (x, y) in enumerate(zip(c, o, strict=True)) if x != y), 12) for _, o, e, _ in entries if e != d]
        assert got[d] == suffixes.KEY + max(common)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_texts_equal_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i + 10, t, 0.0) for i, t in enumerate(texts)] + [(None, texts[40], 0.0)], "doc_id bigint, text string, weight double")
    got = {r.doc_id - 10: (r.class_id - 10, r.kept) for r in near_texts.near_duplicates(df.repartition(3)).collect()}
    idf = near_texts.frequencies(df.filter("doc_id is not null"))
    rows = list(near_texts.shingles(pa.array(texts, pa.string())))
    low = list(range(len(rows)))
    for i, x in enumerate(rows):
        for j in range(i + 1, len(rows)):
            if len(x) and len(rows[j]) and low[i] != low[j] and near_texts.weighted_jaccard(x, rows[j], idf) >= 0.8:
                a, b = sorted((low[i], low[j]))
                low = [a if v == b else v for v in low]
    assert got == {i: (v, v == i) for i, v in enumerate(low)}
    assert len(set(low)) < len(low) - 8
    assert near_texts.near_duplicates(df.limit(0)).count() == 0


def test_rounds_settle_groups_of_unlike_members(spark, monkeypatch):
    """One bucket for all: every pair of a group must be settled, and long chains followed."""
    monkeypatch.setattr(near_texts, "TILE_TEXTS", 7)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(40):  # neighbours are alike, the ends are not
        texts.append(" ".join(base))
        at = (i * 3) % 118
        base[at : at + 2] = [rng.choice(words), rng.choice(words)]
    texts += [prose(rng, words, 120) for _ in range(20)]
    rng.shuffle(texts)

    def one_bucket(row, idf):
        return np.zeros(near_texts.BANDS, np.int64), float(idf[row >> np.uint32(12)].sum())

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(near_texts, "signature", one_bucket)
    got = {r.doc_id: r.class_id for r in near_texts.near_duplicates(df).collect()}
    idf = near_texts.frequencies(df)
    rows = list(near_texts.shingles(pa.array(texts)))
    low = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if low[i] != low[j] and near_texts.weighted_jaccard(rows[i], rows[j], idf) >= 0.8:
                a, b = sorted((low[i], low[j]))
                low = [a if v == b else v for v in low]
    assert got == dict(enumerate(low))


def test_toxic_stems_and_single_insults(spark):
    """Stems whose endings change, in a language of its own, and one insult in a long text."""
    rng = random.Random(6)
    insults = ["moron", "clown", "loser", "scum", "idiot"]
    rows, labels = [], []
    for i in range(900):
        toxic, german = i % 8 == 0, i % 2 == 0
        if i % 16 == 8:
            words = prose(rng, ENGLISH, 40).split() + rng.sample(insults, rng.randint(1, 3))
        else:
            words = prose(rng, GERMAN if german else ENGLISH, 40).split()
            if toxic:  # each whole word is in very few texts
                words += ["achlich" + "".join(rng.choice("abcdefghik") for _ in range(3)) for _ in range(3)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 700:
            labels.append((i, 0, int(toxic)))
    rows += [(1000 + k, prose(rng, ENGLISH, 300) + f" {word} " + prose(rng, ENGLISH, 300)) for k, word in enumerate(insults)]
    rows += [(1100, prose(rng, ENGLISH, 600)), (1101, prose(rng, GERMAN, 600))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, poor int, toxic int"), ["poor", "toxic"])
    got = {r.doc_id for r in chain.score(docs).filter("_p_toxic >= 0.5").collect()}
    assert {i for i in got if 700 <= i < 900} == {i for i in range(700, 900) if i % 8 == 0}
    assert {i for i in got if i >= 1000} == {1000 + k for k in range(len(insults))}


def test_near_copy_of_a_text_in_a_third_of_the_rows(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(100)]
    near = [*base[:50], "changed", *base[51:]]
    texts = [" ".join(near)] + [" ".join(base)] * 300 + [prose(rng, words, 100) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = near_texts.near_duplicates(df)
    assert sorted(r.doc_id for r in got.filter("class_id = 0").collect()) == list(range(301))
    assert got.filter("kept").count() == 601
