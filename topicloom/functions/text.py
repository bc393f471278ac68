"""Article cleaning as chains of column expressions.

A cleaning profile is a list of rules applied in order; the order is part of the meaning. Each rule
is ``(kind, what, replacement)``:

* ``regex``   - regular expression, replaced everywhere
* ``literal`` - plain text, replaced everywhere from left to right
* ``delete``  - set of single characters to remove
* ``trim``    - blanks at both ends removed

Character classes are written out (``\\p{Nd}``, ``\\p{L}``, explicit white space) so that the rules
mean the same in every engine.
"""

from __future__ import annotations

import functools
import itertools
import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.vectors import let

Rule = tuple[str, str, str]

# Unicode white space, for use inside a character class.
OTHER_SPACE = r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = " " + OTHER_SPACE
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"

# The characters, site names and patterns the cleaning chain is defined by.
SYMBOLS = "–•™©®●▶\ufe0e►…\"$%&()*œ†¥+:;µ≤≥æ«‘π<=>[\\]^_`‚{|}~'"
AGE_IN_BRACKETS = rf" \({DIGIT}+\)"
SCORE_WITH_DASH = rf"{DIGIT}+:+{DIGIT}+-"
SCORE_IN_BRACKETS = rf"\(+{DIGIT}+:+{DIGIT}\)+"
DATE = rf"({DIGIT}{{2}}|{DIGIT})[^\n]({DIGIT}{{2}}|{DIGIT})[^\n]{DIGIT}{{4}}"
URL = rf"http[^{SPACE}]+[{SPACE}]*"
EURO_PREFIX = r"^[0-9]+(\.[0-9][0-9])?€"
SLASHED_WORDS = rf"({WORD})/({WORD}+)"
BILD = [r"(?i)bild[^\n]de", r"(?i)bildplus", r"(?i)bild plus", r"(?i)mehr gleich bei bild[^\n]"]
DASH_AFTER_SPACE = rf"[{SPACE}]+-"
SPACE_RUN = rf"[{SPACE}]{{2,}}|[{OTHER_SPACE}]"
LAST_COMMA = r",\z"
TITLE_MARKERS = ["bild.de", "Bild.de", "*** BILDplus Inhalt ***"]
ARROW = "➡\ufe0f"


def _rules(*, newline: str = "", legacy: bool = False) -> list[Rule]:
    rules: list[Rule] = [
        ("regex", AGE_IN_BRACKETS, ""),
        ("regex", SCORE_WITH_DASH, ""),
        ("regex", SCORE_IN_BRACKETS, ""),
        ("delete", SYMBOLS, ""),
        ("regex", BILD[0], ""),
    ]
    if not legacy:
        rules.append(("regex", r"(?i)derStandard[^\n]at", "derStandard"))
    rules += [("regex", BILD[1], ""), ("regex", BILD[2], "")]
    if not legacy:
        rules += [("regex", BILD[3], ""), ("regex", DATE, "")]
    rules += [("literal", "!", "."), ("literal", "\n", newline)]
    rules += [("literal", " " * n, " ") for n in range(3, 20)]
    rules += [
        ("literal", "...", "."),
        ("regex", DASH_AFTER_SPACE, ""),
        ("regex", URL, ""),
        ("regex", EURO_PREFIX, ""),
        ("literal", " €", " EURO"),
        ("literal", " £", " POUNDS"),
        ("delete", "“„\xa0\xad\u2005", ""),
        ("literal", "\u2009", " "),
        ("literal", " . ", ". "),
        ("regex", SLASHED_WORDS, "$1 $2"),
    ]
    if not legacy:
        rules.append(("literal", ARROW, ""))
    rules.append(("literal", "  ", " "))
    if not legacy:
        rules += [("regex", SPACE_RUN, " "), ("trim", "", "")]
    rules += [("literal", "..", "."), ("literal", " .  ", ". ")]
    if not legacy:
        return [*rules, ("regex", LAST_COMMA, ""), ("trim", "", "")]
    return [*rules, ("regex", rf"^[{SPACE}]+|[{SPACE}]+\z", "")]


def cleaning_rules(profile: str = "reference", newline: str = "") -> list[Rule]:
    """Rules of a profile: ``reference``, or ``legacy`` without the later additions.

    ``newline`` is what a line break turns into. Empty joins the words on both sides, as the
    original chain does; pass a space to keep them apart.
    """
    if profile not in ("reference", "legacy"):
        raise ValueError(f"unknown cleaning profile {profile!r}")
    return _rules(newline=newline, legacy=profile == "legacy")


# Rules of the harder cleaning used before tokenizing.
HARD_RULES: list[Rule] = [
    ("delete", string.punctuation, ""),
    ("regex", rf"{DIGIT}[^\n]", ""),
    ("literal", "\n", ""),
    ("literal", " " * 37, " "),
    ("regex", r"bild[^\n]de", ""),
    ("literal", "bildplus", ""),
    ("literal", "\u2009", " "),
    ("regex", rf"[{SPACE}]–[{SPACE}]", " "),
    ("regex", DIGIT, ""),
    ("delete", "„‚“\u2005", ""),
    ("literal", "\xa0", " "),
    ("literal", "  ", " "),
    ("regex", rf"^[{SPACE}]+|[{SPACE}]+\z", ""),
]


# Texts without what a rule looks for are passed by: (rules, test of the text). A text that fails the test is left alone by every rule of its group.
_GUARDS: list[tuple[Callable[[Rule], bool], Callable[[Column], Column]]] = [
    (lambda r: r == ("regex", AGE_IN_BRACKETS, ""), lambda t: t.contains(" (")),
    (lambda r: r in [("regex", SCORE_WITH_DASH, ""), ("regex", SCORE_IN_BRACKETS, "")], lambda t: t.contains(":")),
    (lambda r: r in [("regex", p, "") for p in BILD], lambda t: t.rlike("(?i)bild")),
    (lambda r: r[0] == "literal" and len(r[1]) >= 3 and not r[1].strip(" "), lambda t: t.contains("   ")),
    (lambda r: r == ("regex", DASH_AFTER_SPACE, ""), lambda t: t.contains("-")),
    (lambda r: r == ("regex", SLASHED_WORDS, "$1 $2"), lambda t: t.contains("/")),
    (lambda r: r == ("regex", LAST_COMMA, ""), lambda t: t.endswith(",")),
]

# The same matches by patterns that turn most characters down with one comparison.
_QUICK = {
    DATE: rf"(?![ :-~]){DATE}",
    DASH_AFTER_SPACE: rf"(?![!-~]){DASH_AFTER_SPACE}",
    SPACE_RUN: rf"(?![!-~])(?: [{SPACE}]+|[{OTHER_SPACE}][{SPACE}]*)",
}


def _class(chars: str) -> str:
    """Any one of ``chars``; characters beyond ASCII are only compared with the others beyond it."""
    code = lambda some: "[" + "".join(rf"\x{{{ord(c):x}}}" for c in some) + "]"
    low, high = [c for c in chars if ord(c) < 128], [c for c in chars if ord(c) >= 128]
    return "|".join([code(low)] * bool(low) + [r"(?![\x00-\x7f])" + code(high)] * bool(high))


def _apply(c: Column, rule: Rule) -> Column:
    kind, what, repl = rule
    if kind == "regex":
        return F.regexp_replace(c, _QUICK.get(what, what), repl)
    if kind == "literal":
        return F.replace(c, F.lit(what), F.lit(repl))
    if kind == "delete":
        return F.regexp_replace(c, _class(what), "")
    if kind == "trim":
        return F.trim(c)
    raise ValueError(f"unknown rule kind {kind!r}")


def apply_rules(col: Column, rules: list[Rule]) -> Column:
    """Fold a rule list over a string column. No UDF; neighboring rules with the same test are skipped together where it fails."""

    def guard(rule: Rule) -> int | None:
        return next((i for i, (of, _) in enumerate(_GUARDS) if of(rule)), None)

    def step(c: Column, group: tuple[int | None, Iterable[Rule]]) -> Column:
        which, some = group[0], list(group[1])
        if which is None:
            return functools.reduce(_apply, some, c)
        return let(c, lambda t: F.when(_GUARDS[which][1](t), functools.reduce(_apply, some, t)).otherwise(t))

    return functools.reduce(step, itertools.groupby(rules, guard), col)


def clean_article(col: Column, lower: bool = False, profile: str = "reference", newline: str = "") -> Column:
    """Soft cleaning of article text before embedding."""
    out = apply_rules(col, cleaning_rules(profile, newline))
    return F.lower(out) if lower else out


def clean_hard(col: Column) -> Column:
    """Lower-case, drop punctuation, digits and quotes. Stemming is a job of its own (tokens.stem)."""
    return apply_rules(F.lower(col), HARD_RULES)


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (SQL ``trim`` only knows U+0020)."""
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def strip_title_marker(col: Column, remove_section: bool = False, keep_unmarked: bool = True) -> Column:
    """Drop the site suffix of a title: the last ``-`` part, or the last two with ``remove_section``.

    A title without ``-`` stays as it is. ``keep_unmarked=False`` gives the older behavior, where
    such a title lost its only part.
    """
    base = col
    for marker in TITLE_MARKERS:
        base = F.replace(base, F.lit(marker), F.lit(""))
    base = F.replace(base, F.lit("\xa0"), F.lit(" "))
    parts = F.split(base, "-")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (2 if remove_section else 1), F.lit(0)))
    cut = strip(F.array_join(F.transform(kept, strip), " "))
    return F.when(base.contains("-"), cut).otherwise(base) if keep_unmarked else cut


def sentences_by_dot(col: Column) -> Column:
    """Parts between dots, trimmed. Empty parts go before trimming, so a lone space leaves ''."""
    return F.transform(F.filter(F.split(col, r"\."), lambda s: s != ""), strip)


def sentences(col: Column) -> Column:
    """Sentences ending in ``.``, ``!`` or ``?``; the mark stays with its sentence."""
    return F.filter(
        F.transform(F.regexp_extract_all(col, F.lit(r"([^.!?]+[.!?]*)"), 1), strip), lambda s: s != ""
    )


def first_words(col: Column, n: int) -> Column:
    """The first ``n`` space-separated words."""
    return F.array_join(F.slice(F.split(col, " "), 1, n), " ")


def no_punctuation(col: Column) -> Column:
    """Remove ASCII punctuation."""
    return F.translate(col, string.punctuation, "")


def words(col: Column) -> Column:
    """Lower-case tokens of at least two word characters, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(rf"({WORD}{{2,}})"), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighboring tokens joined by a space, in order."""
    if n == 1:
        return tokens

    def runs(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)
