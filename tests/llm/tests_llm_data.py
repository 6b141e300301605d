"""A small corpus with one planted case for each stage."""

import random

WORDS = [f"{a}{b}{c}" for a in ("st", "br", "tr", "pl", "gr") for b in ("one", "ade", "ick", "um", "ell") for c in ("s", "ing", "ed", "er", "y", "ful")]


def documents():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = []
    for i in range(300):
        text = prose(rng.randint(20, 80))
        rows.append((i, text + " filthy vile filthy" if i % 6 == 0 else text, "en"))
    copy = prose(100)
    rows += [(800, copy, "en"), (801, copy, None), (802, copy + " extra", "en")]
    passage = " ".join(["passage", prose(90)])
    rows += [(810 + k, f"{prose(150)} {passage} {prose(150)}", "en") for k in range(3)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "1234 --", None), (None, prose(30), "en")]
    return [(d, t, lang, "s", None if t is None else len(t), "x", 1) for d, t, lang in rows]


def labels():
    return [(i, 1, int(i % 6 == 0)) for i in range(240)]
