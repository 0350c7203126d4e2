"""Text expressions shared by the operators.

All of these are plain Catalyst expressions: they run in the JVM inside
whole-stage codegen, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that must equal the reference's libraries.
# Python ``str.isspace()`` (used by ``str.strip()`` in the HTML text rule):
PY_SPACE = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Unicode White_Space (Rust ``char::is_whitespace``, used by the title trim):
UNI_SPACE = (r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# Word pattern for the vocabulary: runs of letters/digits/underscore,
# or any single other non-space character.
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def unicode_trim(col: Column, space_class: str = UNI_SPACE) -> Column:
    """Strip leading and trailing whitespace of every kind, not only U+0020."""
    return F.regexp_replace(col, f"^[{space_class}]+|[{space_class}]+$", "")


def rouge_tokens(col: Column) -> Column:
    """ROUGE tokens: lowercase, non ``[a-z0-9]`` runs are separators."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


# The published Treebank word rules as replacements, in order.
# Look-aheads are written out, and the final full stop of any white-space
# delimited word is cut off (the sentence splitter's list of abbreviations is
# a downloaded model).  Letters in contractions are ASCII.
TREEBANK = (
    (r"([«“‘„]|`+)", r" $1 "), (r'(^|\s)"', r"$1 `` "), (r"(``)", r" $1 "), (r"([ (\[{<])(\"|'')", r"$1 `` "),
    (r"'([a-ce-lo-ru-z0-9_])\b", r"' $1"),
    (r"([^.\s])\.([\])}>\"'»”’]*)(\s|$)", r"$1 . $2 $3"),
    (r"([:,])([^0-9])", r" $1 $2"), (r"([:,])$", r" $1 "), (r"(\.{2,})", r" $1 "), (r"([;@#$%&])", r" $1 "),
    (r"([?!])", r" $1 "), (r"([^'])' ", r"$1 ' "), (r"([*])", r" $1 "),
    (r"([\]\[(){}<>])", r" $1 "), (r"--", r" -- "),
    (r"([»”’])", r" $1 "), (r"''", r" '' "), (r'"', r" '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"$1 $2 "), (r"([^' ])('ll|'re|'ve|n't) ", r"$1 $2 "),
    (r"\b(can)(not)\b", r" $1 $2 "), (r"\b(d)('ye)\b", r" $1 $2 "), (r"\b(gim)(me)\b", r" $1 $2 "), (r"\b(gon)(na)\b", r" $1 $2 "),
    (r"\b(got)(ta)\b", r" $1 $2 "), (r"\b(lem)(me)\b", r" $1 $2 "), (r"\b(more)('n)\b", r" $1 $2 "), (r"\b(wan)(na)(\s)", r" $1 $2 $3"),
    (r" ('t)(is)\b", r" $1 $2 "), (r" ('t)(was)\b", r" $1 $2 "),
)


BLEU_SPACE = r"[ \t\n\x{0B}\f\r]+"


def bleu_tokens(col: Column) -> Column:
    """Lower-cased words and punctuation marks by the Treebank rules."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(col, F.lit(""))), F.lit(" "))
    for pattern, replacement in TREEBANK:
        text = F.regexp_replace(text, pattern, replacement)
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_tokens(col: Column) -> Column:
    """Lowercased word/punctuation tokens (the vocabulary's tokenizer)."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD_PATTERN), 0)


def whitespace_word_count(col: Column) -> Column:
    """``len(text.split())``: number of whitespace-separated words."""
    return F.size(F.filter(F.split(F.coalesce(col, F.lit("")), f"[{PY_SPACE}]+"), lambda t: t != ""))
