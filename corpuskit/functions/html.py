"""HTML-to-text as a single Catalyst expression.

Rule being reproduced: every text node of the document, each stripped of
surrounding whitespace, empty ones dropped, joined by one space; comments,
doctype, ``<script>``, ``<style>``, ``<template>`` and ruby annotations
contribute no text; character references are decoded exactly once.

Plan: decode every character reference in one left-to-right pass, turning
``& < >`` into private-use sentinels; replace comments and no-text elements,
then every tag, by U+0001; collapse "whitespace, marker, whitespace/markers"
runs into one space; trim; finally turn the sentinels back into ``& < >``.
Because ``<`` and ``>`` only come back at the very end, a decoded
``&lt;p&gt;`` is never mistaken for a tag, and ``&amp;lt;`` decodes to
``&lt;``, as an HTML parser does.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_SPACE

# Stands for markup that was cut out.  A Unicode noncharacter: texts do not
# interchange it, and no character reference decodes to it.
MARK = "\ufdd0"

# Elements whose content is not document text (scripts, style
# sheets, templates, ruby annotations).  The first two hold raw text, so
# without an end tag they run to the end.
RAW_ELEMENTS, HIDDEN_ELEMENTS = ["script", "style"], ["template", "rt", "rp"]
# The names that most references use, tried before the table.
COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\u00a0", "apos;": "'"}


@lru_cache(maxsize=1)
def named_references() -> tuple[dict[str, str], list[str], list[str]]:
    """The HTML5 named character references, from Python's standard library
    table: (name -> decoded text, names that need ``;``, legacy names that
    may omit it)."""
    from html.entities import html5

    values: dict[str, str] = {}
    legacy: set[str] = set()
    for key, val in html5.items():
        name = key[:-1] if key.endswith(";") else key
        values[name] = val
        if not key.endswith(";"):
            legacy.add(name)
    strict = sorted((n for n in values if n not in legacy), key=lambda n: (-len(n), n))
    return values, strict, sorted(legacy, key=lambda n: (-len(n), n))


def c1_replacements() -> dict[int, str]:
    """Numeric references 0x80-0x9F decode as their windows-1252 character
    (the C1 control itself where that code page has none)."""
    out = {}
    for cp in range(0x80, 0xA0):
        try:
            out[cp] = bytes([cp]).decode("cp1252")
        except UnicodeDecodeError:
            out[cp] = chr(cp)
    return out


_SP = f"[{PY_SPACE}]"


def _json_map(d: dict) -> Column:
    import json

    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def _reference_maps() -> tuple[Column, Column]:
    """(names usable with ``;``, legacy names usable without it) -> text."""
    values, _, legacy = named_references()
    return _json_map(values), _json_map({n: values[n] for n in legacy})


LEGACY_MAX = 6  # longest legacy (semicolon-free) reference name


def _codepoint_char(cp: Column) -> Column:
    """One numeric reference's text, as an HTML parser decodes it: NUL and
    out-of-range or surrogate code points give U+FFFD, 0x80-0x9F give their
    windows-1252 character, CR stays CR, other control and non-character
    code points give nothing."""
    import json

    c1 = F.from_json(F.lit(json.dumps({str(k): v for k, v in c1_replacements().items()})), "map<string,string>")
    noncharacter = (((cp >= 0x1) & (cp <= 0x8)) | (cp == 0xB) | ((cp >= 0xE) & (cp <= 0x1F)) | (cp == 0x7F)
                    | ((cp >= 0xFDD0) & (cp <= 0xFDEF)) | (cp.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    as_char = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return (F.when((cp == 0) | (cp > 0x10FFFF) | ((cp >= 0xD800) & (cp <= 0xDFFF)), F.lit("\ufffd"))
            .when((cp >= 0x80) & (cp <= 0x9F), F.element_at(c1, cp.cast("string")))
            .when(noncharacter, F.lit(""))
            .otherwise(as_char))


def _decode_numeric(ref: Column) -> Column:
    """Text of a numeric reference ``#NNN`` / ``#xHH`` (``;`` optional)."""
    body = F.regexp_replace(ref, ";$", "")
    is_hex = body.startswith("#x") | body.startswith("#X")
    digits = F.regexp_replace(F.regexp_extract(body, "[0-9a-fA-F]+$", 0), "^0+", "")
    # more digits than any code point has: out of range (no overflow)
    too_long = F.length(digits) > F.when(is_hex, 6).otherwise(7)
    value = F.when(digits == "", F.lit(0).cast("long")).when(
        is_hex, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    return _codepoint_char(F.when(too_long, F.lit(0x110000).cast("long")).otherwise(value))


def decode_references(s: Column) -> Column:
    """Decode character references in one left-to-right pass, linear in
    the text.

    Split at ``&``; for each following piece: a numeric reference at its
    start is decoded; otherwise its leading name is looked up (with ``;``
    in the full table, without ``;`` among the legacy names), and failing
    that the longest legacy name that prefixes it; any other piece gets its
    ``&`` back.  Each ``&`` is looked at once, so ``&amp;lt;`` decodes to
    ``&lt;``.  Rows without ``&`` skip the work entirely.
    """
    full, legacy = _reference_maps()
    parts = F.split(s, "&")

    def rest(p: Column, n: Column) -> Column:
        return F.substring(p, n + 1, 1 << 30)

    def by_table(p: Column, full: Column, legacy: Column) -> Column:
        num = F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        cand = F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]*;?", 0)
        name = F.regexp_replace(cand, ";$", "")
        res = (F.when(num != "", F.concat(_decode_numeric(num), rest(p, F.length(num))))
                .when(cand.endswith(";") & F.try_element_at(full, name).isNotNull(),
                      F.concat(F.try_element_at(full, name), rest(p, F.length(cand))))
                .when(F.try_element_at(legacy, name).isNotNull(),
                      F.concat(F.try_element_at(legacy, name), rest(p, F.length(name)))))
        for k in range(LEGACY_MAX, 1, -1):  # longest legacy prefix
            pre = F.substring(name, 1, k)
            res = res.when((F.length(name) > k) & F.try_element_at(legacy, pre).isNotNull(),
                           F.concat(F.try_element_at(legacy, pre), rest(p, F.lit(k))))
        return res.otherwise(F.concat(F.lit("&"), p))

    # the tables are bound once: as literals in every branch they would
    # take longer to plan than the texts take to decode
    tables = F.array(F.struct(full.alias("full"), legacy.alias("legacy")))

    def piece(p: Column) -> Column:
        res = None
        for common, text in COMMON.items():
            value = F.concat(F.lit(text), rest(p, F.lit(len(common))))
            res = F.when(p.startswith(common), value) if res is None else res.when(p.startswith(common), value)
        return res.otherwise(F.element_at(F.transform(tables, lambda t: by_table(p, t["full"], t["legacy"])), 1))

    decoded = F.concat(F.element_at(parts, 1),
                       F.array_join(F.transform(F.slice(parts, 2, 1 << 30), piece), ""))
    return F.when(F.instr(s, "&") > 0, decoded).otherwise(s)


def html_to_text(col: Column) -> Column:
    """Text content of an HTML string (NULL or empty -> ``""``).

    Markup is cut out before references are decoded, so a decoded ``<`` is
    never taken for a tag.  A tag ends at the first ``>`` outside its quoted
    attribute values (at the first ``>`` at all if its quotes do not pair).
    """
    raw, hidden = "|".join(RAW_ELEMENTS), "|".join(HIDDEN_ELEMENTS)
    s = F.coalesce(col, F.lit(""))
    # one pattern with one first character, so other text is skipped quickly
    s = F.regexp_replace(s, rf"(?is)<(?:!--.*?-->|({raw})\b[^>]*>.*?(?:</\1\s*>|\z)|({hidden})\b[^>]*>.*?</\2\s*>)", MARK)
    s = F.regexp_replace(s, r"""<(?:[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[a-zA-Z/!?][^>]*>)""", MARK)
    s = decode_references(s)
    # strip each text node, drop empty ones, join with one space
    s = F.regexp_replace(s, f"{_SP}*+{MARK}[{PY_SPACE}{MARK}]*+", " ")
    return F.regexp_replace(s, f"^{_SP}+|{_SP}+$", "")
