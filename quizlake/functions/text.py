"""Text columns. Everything stays in the JVM except `nfc`, which only ships rows that
can change under normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------
# White space as the UI language sees it, and as the text worker sees it. A class of many ranges
# is tried one range after another, so visible ASCII is turned away first.
WEB_SPACE = r"[\P{Graph}&&[\s\x{A0}[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
DOC_SPACE = r"[\P{Graph}&&[\s\x{1C}-\x{1F}\x{85}\x{A0}[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"
# The same as plain characters, for trimming without a pattern.
_WIDE_SPACES = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WEB_SPACES = " \t\n\x0b\f\r" + _WIDE_SPACES + "\ufeff"
DOC_SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" + _WIDE_SPACES
WORD = r"[\p{L}\p{N}_]"
# Question, option and enumeration markers.
QUESTION_MARK = r"\?"
MCQ_PARENS = rf"\({WEB_SPACE}*[A-Da-d]{WEB_SPACE}*\)"
MCQ_DOT = rf"(?m)(?:^|{WEB_SPACE})[A-Da-d]{WEB_SPACE}*[).]{WEB_SPACE}"
ROMAN_ITEM = rf"(?i)(?:^|{WEB_SPACE})(?:i{{1,3}}|iv|v|vi{{0,3}}|ix|x){WEB_SPACE}*[).:]"
STEM_LABEL = rf"(?i)^{DOC_SPACE}*(?:Q(?:uestion)?{DOC_SPACE}*)?\p{{Nd}}+{DOC_SPACE}*[).:]"
OPTION_PAREN = rf"(?s)^{DOC_SPACE}*\({DOC_SPACE}*([A-Ea-e]){DOC_SPACE}*\){DOC_SPACE}*[).:]{DOC_SPACE}*(.+)$"
OPTION_DOT = rf"(?s)^{DOC_SPACE}*([A-E]){DOC_SPACE}*[).:]{DOC_SPACE}*(.+)$"
INLINE_OPTION = rf"\({DOC_SPACE}*[A-Da-d]{DOC_SPACE}*\)"
# Words after which a wrapped line is never glued.
NO_GLUE_AFTER = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "nor", "but", "is",
    "are", "was", "were", "be", "been", "as", "if", "so", "no", "do", "we", "he", "she", "it",
    "us", "am", "by", "from", "with",
)
# Words that start a clause and are never glued to the line above.
NO_GLUE_BEFORE = (
    "and", "or", "but", "which", "who", "whom", "whose", "that", "this", "these", "those",
    "when", "where", "why", "how", "if", "then", "because", "although", "while", "the", "in",
    "on", "at", "of", "for", "from", "with", "by", "as", "is", "are", "was", "were", "be",
    "been", "being", "has", "have", "had", "not", "no", "can", "may", "will", "would", "could",
    "should",
)
# Auxiliaries that are not the second half of a split capitalised word.
NO_JOIN_SECOND = (
    "has", "have", "had", "is", "are", "was", "were", "been", "being", "be", "can", "may",
    "will", "would", "could", "should",
)
# Cross-line repairs: (pattern, replacement).
CROSS_LINE_REPAIRS = ((r"(?i)\bquoru\s*\n\s*m\.\s*Quorum\s+is\s*\?", "quorum is?"),)
LONG_LAST_WORD = 6
REPLACEMENT_CHAR = "�"
OPTION_LETTERS = ("A", "B", "C", "D", "E")
REQUIRED_LETTERS = ("A", "B", "C", "D")
SKIP_CONFIDENCE = {"exam": 0.93, "fast": 0.87, "pyq": 0.87, "notes": 0.87}
# -----------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_web(c: Column) -> Column:
    return F.btrim(_col(c), F.lit(WEB_SPACES))


def ltrim_doc(c: Column) -> Column:
    return F.ltrim(_col(c), F.lit(DOC_SPACES))


def rtrim_doc(c: Column) -> Column:
    return F.rtrim(_col(c), F.lit(DOC_SPACES))


def trim_doc(c: Column) -> Column:
    return F.btrim(_col(c), F.lit(DOC_SPACES))


def normalize_ocr(c: Column | str) -> Column:
    """Comparison form for frame text: lower case, letters, digits and light punctuation."""
    c = F.regexp_replace(F.lower(_col(c)), f"{WEB_SPACE}+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N} ?.:();-]", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def frequency_key(c: Column | str) -> Column:
    """Counting form for stems: punctuation deleted, first 200 characters."""
    c = F.regexp_replace(F.lower(_col(c)), f"{WEB_SPACE}+", " ")
    return F.substring(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N} ]+", "")), 1, 200)


def dedupe_key(c: Column | str) -> Column:
    """Comparison form for question stems."""
    c = F.regexp_replace(F.lower(_col(c)), f"{DOC_SPACE}+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_ ?.:();%\-/]", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def jaccard_tokens(c: Column | str) -> Column:
    """Lower-cased letter/digit runs, repeats kept."""
    c = F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(c, " "), lambda t: t != "")


def sorted_tokens(c: Column | str) -> Column:
    """Tokens of an already normalised text in code-point order, joined by one space."""
    return F.array_join(F.sort_array(F.filter(F.split(_col(c), " "), lambda t: t != "")), " ")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that is computed once, however often it is used inside."""
    return F.transform(F.array(value), make)[0]


def numbered_tokens(tokens: Column) -> Column:
    """Tokens in order, each with the number of its repeat: sets of these intersect as the
    token arrays do as multisets. One pass over the sorted tokens finds where each run of
    equal ones starts, one over the runs numbers them."""

    def runs(s: Column) -> Column:
        starts = F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i))

        def number(p: Column) -> Column:
            def run(at: Column, k: Column) -> Column:
                end = F.coalesce(F.get(p, k + 1), F.size(s))
                return F.transform(F.sequence(at, end - 1), lambda j: F.concat_ws("#", F.get(s, at), (j - at).cast("string")))

            return F.flatten(F.transform(p, run))

        return bound(F.filter(starts, lambda i: i.isNotNull()), number)

    return bound(F.sort_array(tokens), runs)


def numbered_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of numbered tokens; two empty arrays score 1."""
    inter = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(inter / (total - inter))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays as multisets; two empty arrays score 1."""
    return numbered_jaccard(numbered_tokens(a), numbered_tokens(b))


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest)
    )


def question_mark(c: Column) -> Column:
    return _col(c).rlike(QUESTION_MARK)


def mcq_style(c: Column) -> Column:
    text = trim_web(c)
    return text.rlike(MCQ_PARENS) | text.rlike(MCQ_DOT)


def roman_enumeration(c: Column) -> Column:
    return trim_web(c).rlike(ROMAN_ITEM)


def is_stem_label(c: Column) -> Column:
    return _col(c).rlike(STEM_LABEL)


def upper_letter(c: Column) -> Column:
    """Upper case of an option letter, without the tables of a whole script."""
    return F.translate(c, "".join(OPTION_LETTERS).lower(), "".join(OPTION_LETTERS))


def option_letter(c: Column) -> Column:
    """Upper-case letter of an option line, NULL for any other line."""
    c = _col(c)
    found = F.coalesce(
        F.nullif(F.regexp_extract(c, OPTION_PAREN, 1), F.lit("")),
        F.nullif(F.regexp_extract(c, OPTION_DOT, 1), F.lit("")),
    )
    return upper_letter(found)


def option_text(c: Column) -> Column:
    c = _col(c)
    found = F.coalesce(
        F.nullif(F.regexp_extract(c, OPTION_PAREN, 2), F.lit("")),
        F.regexp_extract(c, OPTION_DOT, 2),
    )
    return trim_doc(found)


def inline_trigger(c: Column) -> Column:
    c = _col(c)
    return c.rlike(INLINE_OPTION) & (F.length(c) - F.length(F.replace(c, F.lit("("))) >= 2)


@F.pandas_udf(T.StringType())
def _nfc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    """Canonical composition. It is the identity below U+0300, so other rows never leave
    the JVM (their UDF input is NULL)."""
    c = _col(c)
    changeable = c.rlike(r"[^\x{0}-\x{2FF}]")
    return F.when(changeable, _nfc_batch(F.when(changeable, c))).otherwise(c)


def clean_newlines(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("﻿"), F.lit("")), F.lit("­"), F.lit(""))
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _alternation(words: tuple[str, ...]) -> str:
    return "|".join(words)


def merge_wrapped(c: Column | str) -> Column:
    """Undo line wraps of recognised text. One left-to-right fold over the lines of one row:
    the decision looks at the already merged buffer, so it is an `aggregate`, not a window."""
    lines = F.transform(
        F.split(clean_newlines(_col(c)), "\n", -1),
        lambda raw: F.struct(raw.alias("raw"), rtrim_doc(raw).alias("held"), ltrim_doc(raw).alias("tail")),
    )
    lines = F.transform(
        lines,
        lambda x: F.struct(
            x["raw"].alias("raw"), x["held"].alias("held"), x["tail"].alias("tail"), ltrim_doc(x["held"]).alias("body")
        ),
    )
    lines = F.transform(
        lines,
        lambda x: F.struct(
            x["raw"].alias("raw"),
            x["held"].alias("held"),
            x["tail"].alias("tail"),
            x["body"].alias("body"),
            (
                x["body"].rlike(STEM_LABEL)
                | x["body"].rlike(OPTION_PAREN)
                | x["body"].rlike(OPTION_DOT)
            ).alias("starts_block"),
            (
                x["body"].rlike(r"^\p{Ll}")
                & ~x["body"].rlike(f"^[a-z]{{1,2}}\\.{DOC_SPACE}+")
                & ~F.lower(x["body"]).rlike(f"^(?:{_alternation(NO_GLUE_BEFORE)})(?!{WORD})")
            ).alias("may_follow"),
        ),
    )
    none = F.lit(None).cast("string")

    def state(done: Column, buf: Column, held: Column) -> Column:
        # `held` is the right-trimmed buffer, kept so that no step has to trim it again.
        return F.struct(done.alias("done"), buf.alias("buf"), held.alias("held"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["held"]
        # The last word is judged on the tail of the buffer, however long the buffer grows.
        end = F.right(held, F.lit(LONG_LAST_WORD))
        may_lead = (
            end.rlike(r"[\p{L}\p{N}]$")
            & ~end.rlike(f"^{WORD}{{{LONG_LAST_WORD}}}$")
            & ~F.lower(end).rlike(f"(?:^|(?!{WORD}).)(?:{_alternation(NO_GLUE_AFTER)})$")
        )
        flushed = F.when(acc["buf"].isNull(), acc["done"]).otherwise(
            F.array_append(acc["done"], acc["buf"])
        )
        cut = F.substring(held, F.lit(1), F.length(held) - 1)
        return (
            F.when(x["body"] == "", state(F.array_append(flushed, x["raw"]), none, none))
            .when(acc["buf"].isNull() | x["starts_block"], state(flushed, x["raw"], x["held"]))
            .when(
                held.endswith("-"),
                state(acc["done"], F.concat(cut, x["tail"]), F.concat(cut, x["body"])),
            )
            .when(
                x["may_follow"] & may_lead,
                state(acc["done"], F.concat(held, x["tail"]), F.concat(held, x["body"])),
            )
            .otherwise(state(flushed, x["raw"], x["held"]))
        )

    return F.aggregate(
        lines,
        state(F.array().cast("array<string>"), none, none),
        step,
        lambda acc: F.array_join(
            F.when(acc["buf"].isNull(), acc["done"]).otherwise(
                F.array_append(acc["done"], acc["buf"])
            ),
            "\n",
        ),
    )


def repair_cross_line(c: Column, repairs=CROSS_LINE_REPAIRS) -> Column:
    for pattern, replacement in repairs:
        c = F.regexp_replace(c, pattern, replacement)
    return c


# White space inside one line, and what may follow a split half.
_BLANK = rf"(?:(?!\n){DOC_SPACE})"
_SPLIT_END = rf"(?={DOC_SPACE}|[?.!,;:]|$)"


def repair_split_words(c: Column | str) -> Column:
    """Join words split inside a line (`quoru m`, `Trip ura`) and split glued auxiliaries.
    Line feeds separate lines; no pattern may reach across one."""
    c = _col(c)
    c = F.regexp_replace(c, rf"(?md)({WORD}{{4,}}) ({WORD}){_SPLIT_END}", "$1$2")
    excluded = _alternation(NO_JOIN_SECOND)
    c = F.regexp_replace(
        c,
        rf"(?md)(?<!{WORD})([A-Z][a-z]{{2,}}){_BLANK}+(?!(?:{excluded})(?!{WORD}))"
        rf"([a-z]{{3,4}})(?!{WORD})(?={DOC_SPACE}|[?.!,;:]|$|{_BLANK}*\()",
        "$1$2",
    )
    return F.regexp_replace(c, rf"(?<!{WORD})([A-Z][a-z]{{3,}})has(?!{WORD})", "$1 has")


def repaired_text(c: Column | str) -> Column:
    """Full repair chain in front of line based question extraction."""
    return repair_split_words(repair_cross_line(merge_wrapped(nfc(c))))


def format_timestamp(c: Column | str) -> Column:
    c = _col(c).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < F.lit(float("inf")))
    sec = F.floor(F.when(ok, c).otherwise(F.lit(0.0)))
    hours = F.floor(sec / 3600)
    minutes = F.floor((sec % 3600) / 60)
    seconds = sec % 60
    return F.when(
        hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, seconds)
    ).otherwise(F.format_string("%d:%02d", minutes, seconds))


def video_id(c: Column | str) -> Column:
    """Eleven character video id from a bare id or one of the known URL shapes."""
    raw = trim_web(_col(c))
    ident = r"^[a-zA-Z0-9_-]{11}$"
    host = F.regexp_replace(F.lower(F.try_parse_url(raw, F.lit("HOST"))), r"^www\.", "")
    path = F.try_parse_url(raw, F.lit("PATH"))
    query_id = F.try_parse_url(raw, F.lit("QUERY"), F.lit("v"))
    short_id = F.regexp_extract(path, r"^/?([^/]*)", 1)
    nested = F.nullif(
        F.regexp_extract(path, r"^/(?:embed|shorts|live)/([a-zA-Z0-9_-]{11})", 1), F.lit("")
    )
    return (
        F.when(raw.rlike(ident), raw)
        .when(host == "youtu.be", F.when(short_id.rlike(ident), short_id))
        .when(
            host.isin("youtube.com", "m.youtube.com"),
            F.when(path == "/watch", F.when(query_id.rlike(ident), query_id)).otherwise(nested),
        )
    )


def topic_slug(c: Column | str) -> Column:
    c = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(c, "^-|-$", ""), 1, 48)


def escape_html(c: Column | str) -> Column:
    c = _col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def escape_minimal(c: Column | str) -> Column:
    c = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(c, F.lit("<"), F.lit("&lt;"))


def unwrap_fence(c: Column | str, language: str = "json") -> Column:
    """Body of the first code fence, or the whole trimmed reply."""
    c = _col(c)
    fenced = F.regexp_extract(c, rf"(?is)```(?:{language})?\s*(.*?)```", 1)
    return trim_web(bound(fenced, lambda f: F.when(f != "", f).otherwise(c)))


def options_text(options: Column | str) -> Column:
    """`A:one|B:two`, keys sorted, values trimmed."""
    entries = F.array_sort(F.map_entries(_col(options)))
    return F.array_join(
        F.transform(
            entries, lambda e: F.concat(e["key"], F.lit(":"), trim_web(F.coalesce(e["value"], F.lit(""))))
        ),
        "|",
    )


def content_hash(stem: Column | str, options: Column | str) -> Column:
    body = F.lower(F.regexp_replace(trim_web(_col(stem)), f"{WEB_SPACE}+", " "))
    return F.sha2(F.concat(body, F.lit("::"), options_text(options)), 256)


# Word edge between an ASCII word character and anything else.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def has_word_break(c: Column) -> Column:
    """A word split by recognition: `quoru m` or `Trip ura`. Of a longer word its last four letters
    tell as much, and are not tried again from each letter; an edge is only sought at a capital."""
    text = trim_web(c)
    return text.rlike(rf"\p{{L}}{{4}}{WEB_SPACE}+\p{{Ll}}{{1,2}}(?={WEB_SPACE}|[?.!,;:]|\z)") | text.rlike(
        rf"(?=\p{{Lu}}){_EDGE}\p{{Lu}}\p{{Ll}}{{2,}}{WEB_SPACE}+\p{{Ll}}{{2,4}}{_EDGE}"
    )


def option_value(options: Column, letter: str) -> Column:
    return F.coalesce(F.try_element_at(options, F.lit(letter)), F.lit(""))


def question_has_word_break(stem: Column, options: Column) -> Column:
    found = has_word_break(F.coalesce(stem, F.lit("")))
    for letter in REQUIRED_LETTERS:
        found = found | has_word_break(option_value(options, letter))
    return found


def structurally_clean(stem: Column, options: Column) -> Column:
    stem = trim_web(F.coalesce(stem, F.lit("")))
    values = [option_value(options, letter) for letter in REQUIRED_LETTERS]
    clean = (F.length(stem) >= 12) & ~stem.contains(REPLACEMENT_CHAR)
    for value in values:
        clean = clean & (trim_web(value) != "") & ~value.contains(REPLACEMENT_CHAR)
    # What is left without the rest: runs of it are far fewer than letters.
    share = F.length(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", "")) / F.greatest(F.length(stem), F.lit(1))
    return clean & (share >= 0.45)


def fit_to_skip(stem: Column, options: Column) -> Column:
    """Whether clean-up may be left out, if the confidence will do; the same for every mode."""
    return ~question_has_word_break(stem, options) & structurally_clean(stem, options)


def needs_cleanup_of(fit: Column, confidence: Column, mode: str) -> Column:
    """Whether a question goes to the enrichment model, from `fit_to_skip`."""
    if mode == "notes":
        return F.lit(False)
    return ~(fit & (confidence >= SKIP_CONFIDENCE.get(mode, 0.87)))


def needs_cleanup(stem: Column, options: Column, confidence: Column, mode: str) -> Column:
    """Whether a question goes to the enrichment model."""
    if mode == "notes":
        return F.lit(False)
    # The confidence first: the patterns are not tried on what it sends there anyway.
    return ~((confidence >= SKIP_CONFIDENCE.get(mode, 0.87)) & fit_to_skip(stem, options))
