"""Porter stemming as one Catalyst expression (the 1980 paper's steps with the
usual extensions for short ``-ies`` / ``-ied`` words, ``-alli``, ``-fulli``
and ``-logi``).  Applied to a table of distinct tokens, never per occurrence.

A condition on the stem is part of the pattern: with C a run of consonants and
V a run of vowels, ``[C](VC)^m[V]`` is the paper's measure m.  A ``y`` counts
as a vowel after a consonant and as a consonant elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix and replacement of the steps that ask for m > 0 (2, 3)
# and the suffixes that step 4 drops for m > 1, each in the paper's order.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
         "iti", "ous", "ive", "ize")

# the first vowel, then the rest of its run; later consonant and vowel runs
TO_VOWEL = "(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"
RUN_C, RUN_V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_OVER_0 = f"{TO_VOWEL}[aeiou]*[^aeiou].*"
M_OVER_1 = f"{TO_VOWEL}[aeiou]*{RUN_C}{RUN_V}[^aeiou].*"
M_IS_1 = f"{TO_VOWEL}[aeiou]*{RUN_C}(?:{RUN_V})?"
CVC_END = "(?:(?:[^aeiouy]|(?:^|[aeiou])y)[aeiouy][^aeiouwxy]|^[aeiou][^aeiou])$"


def _first(word: Column, cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that applies, else the word."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(word)


def _drop(word: Column, n: int, add: str = "") -> Column:
    return F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(add))


def _if_stem(word: Column, condition: str, suffix: str, add: str) -> Column:
    return F.regexp_replace(word, f"^({condition}){suffix}$", f"$1{add}")


def _plural(w: Column) -> Column:
    return _first(w, [(w.endswith("ies") & (F.length(w) == 4), _drop(w, 1)), (w.endswith("sses"), _drop(w, 2)), (w.endswith("ies"), _drop(w, 2)),
                      (w.endswith("ss"), w), (w.endswith("s"), _drop(w, 1))])


def _past(w: Column) -> Column:
    """-eed, -ed, -ing; a stem left by the last two is completed."""
    cut = F.regexp_replace(w, f"^({TO_VOWEL}.*)(?:ed|ing)$", "$1")
    double = cut.rlike("([^aeiouy])\\1$")
    done = _first(cut, [(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e"))), (double & cut.rlike("[^lsz]$"), _drop(cut, 1)), (double, cut),
                        (cut.rlike(f"^{M_IS_1}$") & cut.rlike(CVC_END), F.concat(cut, F.lit("e")))])
    return _first(w, [(w.endswith("ied"), F.when(F.length(w) == 4, _drop(w, 1)).otherwise(_drop(w, 2))), (w.endswith("eed"), _if_stem(w, M_OVER_0, "eed", "ee")), (cut != w, done)])


def _suffixes(w: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return _first(w, [(w.endswith(s), _if_stem(w, M_OVER_0, s, add)) for s, add in rules])


def _step2(w: Column) -> Column:
    w = F.when(w.endswith("alli"), _if_stem(w, M_OVER_0, "alli", "al")).otherwise(w)
    return F.when(w.endswith("logi"), _if_stem(w, M_OVER_0, "ogi", "og")).otherwise(_suffixes(w, STEP2))


def _step4(w: Column) -> Column:
    dropped = lambda s: _if_stem(w, M_OVER_1, s, "")
    return _first(w, [(w.endswith(s), F.when(w.rlike("[st]ion$"), dropped(s)).otherwise(w) if s == "ion" else dropped(s)) for s in STEP4])


def _ending(w: Column) -> Column:
    """A final -e, and one l of a final -ll."""
    bare = _drop(w, 1)
    drop_e = bare.rlike(f"^{M_OVER_1}$") | (bare.rlike(f"^{M_IS_1}$") & ~bare.rlike(CVC_END))
    return F.when(w.endswith("e") & drop_e, bare).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll"), _if_stem(w, f"{TO_VOWEL}[aeiou]*{RUN_C}{RUN_V}(?:[^aeiou].*)?l", "l", "")).otherwise(w)


#: The steps in order.  Each uses its input several times, so apply them one
#: projection at a time (:func:`stems`), not nested.
STEPS = (_plural, _past, lambda w: F.regexp_replace(w, "^(.+(?:[^aeiouy]|[aeiou]y))y$", "$1i"), _step2, lambda w: _suffixes(w, STEP3), _step4, _ending, _last_l)


def stems(tokens, token: str = "token", out: str = "stem", min_length: int = 4):
    """``tokens`` (a DataFrame of distinct lower-case tokens) with the stem of
    each; tokens under ``min_length`` characters are their own stem."""
    step = tokens.withColumn("__w", F.col(token))
    for f in STEPS:
        step = step.withColumn("__w", f(F.col("__w")))
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return step.withColumn(out, F.when(F.length(token) < min_length, F.col(token)).otherwise(
        F.coalesce(F.try_element_at(irregular, F.col(token)), F.col("__w")))).drop("__w")
