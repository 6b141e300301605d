"""The language filter and the toxicity chain against plain forms of the same models."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quizlake.llm import language, toxicity

LANGUAGES = {
    "en": "the and that with this from have were which their would there about people other".split(),
    "de": "und der die das nicht sich auch eine werden zwischen während über könnten mußte straße".split(),
    "fr": "les des une dans pour que qui avec cette être après français où naïve garçon".split(),
}


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def plain_grams(text: str) -> list[str]:
    """4-grams of letters; what lies between letters is one space, none before the first letter."""
    low = text.lower() + "\n"
    kept = "".join(c if c.isalpha() else " " for i, c in enumerate(low) if c.isalpha() or (i and low[i - 1].isalpha()))
    return [kept[i : i + 4] for i in range(len(kept) - 3)]


def test_language_equals_plain_sets(spark):
    """True sets of n-grams per language in place of the filter: they differ only where the
    filter reports an n-gram that it does not hold, which its correction allows for."""
    rng = random.Random(7)
    rows = [(i, prose(rng, LANGUAGES[lang], rng.randint(1, 60)) + rng.choice(["", "!", "  12 x"]), lang)
            for i, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(500))]
    taught, asked = rows[:350], rows[350:] + [(900, "", None), (901, "12 ?", None), (902, "ab", None), (903, "the und les " * 9_000, None)]
    known = language.learn(spark.createDataFrame(taught, "doc_id bigint, text string, lang string"))
    df = spark.createDataFrame([*asked, asked[0]], "doc_id bigint, text string, lang string")
    got = [(r.doc_id, r.l) for r in df.select("doc_id", language.predicted(df, known).alias("l")).collect()]
    assert got[0] == got[-1]  # repeated rows are judged alike

    texts = Counter(r[2] for r in taught)
    counts = defaultdict(Counter)
    for _, text, lang in taught:
        counts[lang].update(set(plain_grams(text)))
    held = {lang: {g for g, n in c.items() if n >= texts[lang] * language.SHARE and (n >= 2 or texts[lang] < 50)} for lang, c in counts.items()}
    order = sorted(texts, key=lambda lang: (-texts[lang], lang))
    for (doc, found), (_, text, _) in zip(got, [*asked, asked[0]], strict=True):
        grams = plain_grams(text)
        if not any(c.isalpha() for c in text):
            assert (found.lang, found.score) == ("und", 0.0)
            continue
        hits = {lang: sum(g in held[lang] for g in grams) for lang in order}
        best = max(order, key=lambda lang: hits[lang])
        assert found.lang == best and found.grams == len(grams), doc
        assert abs(found.score - hits[best] / max(1, len(grams))) < 0.01


def test_levels_equal_a_plain_count():
    rng = random.Random(3)
    texts = [prose(rng, ["Vile", "vileness", "straße", "a", "don't", "x1y2", "über-all", "VILE"], rng.randint(0, 40)) for _ in range(60)] + ["", "...", None]
    names: defaultdict[str, int] = defaultdict(lambda: len(names))
    column = pa.array(["" if t is None else t for t in texts], pa.large_string())
    row, token, level = toxicity._levels(column, names.__getitem__)
    back = {n: w for w, n in names.items()}
    got = {(r, back[t], toxicity.TIMES[k]) for r, t, k in zip(row.tolist(), token.tolist(), level.tolist(), strict=True)}
    want = set()
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        tokens = Counter(t for w in words for t in [w, *(f"{w[:n]}-" for n in toxicity.PREFIXES if len(w) > n)])
        want |= {(i, t, k) for t, n in tokens.items() for k in toxicity.TIMES if n >= k}
    assert got == want


def test_linear_model_is_at_its_optimum():
    """Slopes of the penalised objective: zero where a weight is set, within the penalty where not."""
    rng = np.random.default_rng(4)
    n, width = 600, 300
    dense = rng.random((n, 1))
    x = rng.random((n, width)) < rng.random(width) * 0.2
    y = ((x[:, :5].sum(1) + dense[:, 0] + rng.normal(size=n) * 0.6) > 1.3).astype(float)
    use = (rng.random(n) < 0.8).astype(float)
    row, feature = np.nonzero(x)
    found = toxicity.linear(toxicity.Rows(row, feature, n, width, dense), y, use)
    full = np.column_stack([x, dense])
    mean = (use @ full) / use.sum()
    spread = np.sqrt(((use[:, None] * (full - mean) ** 2).sum(0)) / use.sum())
    share = np.where(y > 0, 0.5 / (y * use).sum(), 0.5 / ((1 - y) * use).sum()) * use
    r = share * (1 / (1 + np.exp(-(full @ found[:-1] + found[-1]))) - y)
    slope = ((full - mean).T @ r) / np.where(spread > 1e-9, spread, np.inf)
    weight = found[:-1] * spread
    assert abs(r.sum()) < 1e-5 and 0 < np.count_nonzero(weight) < width
    some = weight != 0
    assert np.abs(slope[some] + toxicity.PENALTY * np.sign(weight[some])).max() < 1e-4
    assert np.abs(slope[~some]).max() <= toxicity.PENALTY * 1.01


def test_chain_equals_a_plain_chain(spark):
    """The same folds, fitted one after another on dense features in this process."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic, poor = int(rng.random() < 0.25), int(rng.random() < 0.3)
        words = prose(rng, LANGUAGES["en"], 25).split() + ["vile"] * (toxic * rng.randint(0, 2)) + ["zzz"] * (2 * poor)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, poor, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, poor int, toxic int")
    chain = toxicity.fit(docs, marks, ["poor", "toxic"])
    got = {r.doc_id: (r["_p_poor"], r["_p_toxic"]) for r in chain.score(docs.unionByName(docs.limit(3))).collect()}

    fold = np.array([r.f for r in docs.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()])
    names = {w: i for i, w in enumerate(chain.words)}
    row, token, level = toxicity._levels(pa.array([t for _, t in rows], pa.large_string()), names.get)
    feature, size = token * len(toxicity.TIMES) + level, len(names) * len(toxicity.TIMES)
    held, final = [], []
    for k in (1, 2):
        y = np.array([label[k] for label in labels], float)
        fit = lambda before, use, y=y: toxicity.linear(toxicity.Rows(row, feature, len(rows), size, np.array(before).reshape(len(before), len(rows)).T), y, use)
        odds = np.zeros(len(rows))
        for f in range(toxicity.FOLDS):
            w = fit(held, (fold != f).astype(float))
            m = toxicity.Rows(row, feature, len(rows), size, np.array(held).reshape(len(held), len(rows)).T).times(w[:-1]) + w[-1]
            odds[fold == f] = m[fold == f]
        cut = toxicity._best_cut(odds, y)
        w = fit(held, np.ones(len(rows)))
        own = toxicity.Rows(row, feature, len(rows), size, np.array(final).reshape(len(final), len(rows)).T).times(w[:-1]) + w[-1]
        held.append(toxicity._chance(odds - cut))
        final.append(toxicity._chance(own - cut))
    assert np.allclose([got[i] for i in range(len(rows))], np.array(final).T, atol=1e-6)
