"""Registered queries: ROUGE / BLEU scoring of reference-hypothesis pairs,
and their DuckDB restatement (word rules, stemming, overlaps and the longest
common subsequence)."""

from __future__ import annotations

from ..operators import metrics, sentences
from ..sources import derived
from ..sources.tables import table
from .oracle import VIEWS
from .queries_eval import round_doubles
from .registry import register

# The Treebank word rules in RE2's dialect (no look-ahead).
_WORD_RULES = [
    (r"([«“‘„]|`+)", r" \1 "), (r'(^|\s)"', r"\1 `` "), (r"(``)", r" \1 "), (r"([ (\[{<])(\"|'')", r"\1 `` "),
    (r"'([a-ce-lo-ru-z0-9_])\b", r"' \1"), (r"([^.\s])\.([\])}>\"'»”’]*)(\s|$)", r"\1 . \2 \3"),
    (r"([:,])([^0-9])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"(\.{2,})", r" \1 "), (r"([;@#$%&])", r" \1 "), (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "), (r"([*])", r" \1 "), (r"([\]\[(){}<>])", r" \1 "), (r"--", r" -- "), (r"([»”’])", r" \1 "), (r"''", r" '' "), (r'"', r" '' "),
    (r"([^' ])('[smd]|') ", r"\1 \2 "), (r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 "),
    (r"\b(can)(not)\b", r" \1 \2 "), (r"\b(d)('ye)\b", r" \1 \2 "), (r"\b(gim|lem)(me)\b", r" \1 \2 "), (r"\b(gon)(na)\b", r" \1 \2 "),
    (r"\b(got)(ta)\b", r" \1 \2 "), (r"\b(more)('n)\b", r" \1 \2 "), (r"\b(wan)(na)(\s)", r" \1 \2 \3"), (r" ('t)(is|was)\b", r" \1 \2 "),
]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words_sql(x: str) -> str:
    out = f"' ' || lower(coalesce({x}, '')) || ' '"
    for pattern, replacement in _WORD_RULES:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return f"list_filter(regexp_split_to_array({out}, '\\s+'), lambda t: t <> '')"


def _rouge_words_sql(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


# Porter's steps as a chain of select lists over (token, w).  ``m0`` and ``m1``
# say that a stem has more than none / one vowel-consonant change, ``one`` that
# it has exactly one.
_V = "(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"
_M0, _M1 = f"^{_V}[^aeiou]", f"^{_V}[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]"
_ONE = f"^{_V}[^aeiou][^aeiouy]*(?:[aeiouy][aeiou]*)?$"
_CVC = "(?:(?:[^aeiouy]|(?:^|[aeiou])y)[aeiouy][^aeiouwxy]|^[aeiou][^aeiou])$"


def _when_suffix(rules: list[tuple[str, str]], measure: str) -> str:
    cases = " ".join(f"when ends_with(w, '{s}') then case when regexp_matches(left(w, length(w) - {len(s)}), '{measure}')"
                     f" then left(w, length(w) - {len(s)}) || '{r}' else w end" for s, r in rules)
    return f"case {cases} else w end"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("entli", "ent"),
          ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4A = [(s, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent")]
_STEP4B = [(s, "") for s in ("ou", "ism", "ate", "iti", "ous", "ive", "ize")]
_CUT = "regexp_replace(w, '(?:ed|ing)$', '')"
_STEM_STEPS = [
    "case when ends_with(w, 'ies') and length(w) = 4 then left(w, 3) when ends_with(w, 'sses') or ends_with(w, 'ies') then left(w, length(w) - 2) "
    "when ends_with(w, 'ss') then w when ends_with(w, 's') then left(w, length(w) - 1) else w end",
    f"case when ends_with(w, 'ied') then case when length(w) = 4 then left(w, 3) else left(w, length(w) - 2) end "
    f"when ends_with(w, 'eed') then case when regexp_matches(left(w, length(w) - 3), '{_M0}') then left(w, length(w) - 1) else w end "
    f"when {_CUT} <> w and regexp_matches({_CUT}, '^[^aeiou]?[^aeiouy]*[aeiouy]') and regexp_matches({_CUT}, '^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])') then "
    f"case when regexp_matches({_CUT}, '(?:at|bl|iz)$') then {_CUT} || 'e' "
    f"when right({_CUT}, 1) = left(right({_CUT}, 2), 1) and length({_CUT}) > 1 and regexp_matches({_CUT}, '[^aeiouy]$') then "
    f"case when regexp_matches({_CUT}, '[lsz]$') then {_CUT} else left({_CUT}, length({_CUT}) - 1) end "
    f"when regexp_matches({_CUT}, '{_ONE}') and regexp_matches({_CUT}, '{_CVC}') then {_CUT} || 'e' else {_CUT} end else w end",
    "regexp_replace(w, '^(.+(?:[^aeiouy]|[aeiou]y))y$', '\\1i')",
    _when_suffix([("alli", "al")], _M0),
    f"case when ends_with(w, 'logi') then case when regexp_matches(left(w, length(w) - 3), '{_M0}') then left(w, length(w) - 1) else w end else {_when_suffix(_STEP2, _M0)} end",
    _when_suffix(_STEP3, _M0),
    f"case when regexp_matches(w, '(?:{'|'.join(s for s, _ in _STEP4A)})$') then {_when_suffix(_STEP4A, _M1)} "
    f"when ends_with(w, 'ion') then case when regexp_matches(w, '[st]ion$') and regexp_matches(left(w, length(w) - 3), '{_M1}') then left(w, length(w) - 3) else w end "
    f"else {_when_suffix(_STEP4B, _M1)} end",
    f"case when ends_with(w, 'e') and (regexp_matches(left(w, length(w) - 1), '{_M1}') or (regexp_matches(left(w, length(w) - 1), '{_ONE}') "
    f"and not regexp_matches(left(w, length(w) - 1), '{_CVC}'))) then left(w, length(w) - 1) else w end",
    f"case when ends_with(w, 'll') and regexp_matches(left(w, length(w) - 1), '{_M1}') then left(w, length(w) - 1) else w end",
]
_OWN = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
        "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
        "exceed": "exceed", "succeed": "succeed"}


def stem_ctes(source: str) -> str:
    """CTEs that end in ``stems(token, stem)`` over the relation ``source(token)``."""
    out = [f"s0 as (select distinct token, token as w from {source})"]
    for k, step in enumerate(_STEM_STEPS):
        out.append(f"s{k + 1} as (select token, {step} as w from s{k})")
    own = " ".join(f"when '{k}' then '{v}'" for k, v in _OWN.items())
    out.append(f"stems as (select token, case when length(token) < 4 then token else coalesce(case token {own} end, w) end as stem from s{len(_STEM_STEPS)})")
    return ",\n".join(out)


def _overlap_sql(orders: list[int], a: str, b: str) -> str:
    terms = []
    for n in orders:
        gram = lambda c: f"list_transform(range(1, greatest(len({c}) - {n} + 1, 0) + 1), lambda i: array_to_string({c}[i:i + {n} - 1], chr(1)))"
        terms.append(f"(select coalesce(sum(least(cr, ch)), 0) from (select g, count(*) filter (side = 0) as cr, count(*) filter (side = 1) as ch from "
                     f"(select unnest({gram(a)}) as g, 0 as side union all select unnest({gram(b)}) as g, 1 as side) group by g)) as {a}_o{n}")
    return ", ".join(terms)


def _f1_sql(o: str, nr: str, nh: str) -> str:
    p = f"({o}) / greatest({nh}, 1)"
    r = f"({o}) / greatest({nr}, 1)"
    return f"case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end"


def _count(col: str, n: int) -> str:
    return f"greatest(len({col}) - {n} + 1, 0)"


def _bleu_sql(k: float = 5.0) -> str:
    terms, zeros = [], "0"
    for n in (1, 2, 3, 4):
        m = f"wr_o{n}"
        denom = f"greatest(len(wh) - {n} + 1, 1)::double"
        p = (f"(case when {m} > 0 then {m} / {denom} when len(wh) > 1 then "
             f"ln(len(wh)::double) / ({k} * pow(2.0, ({zeros} + 1))) / {denom} else 0.0 end)")
        terms.append(f"(case when {p} > 0 then ln({p}) / 4 else 0.0 end)")
        zeros = f"{zeros} + (case when {m} = 0 then 1 else 0 end)"
    bp = "(case when len(wh) > len(wr) then 1.0 else exp(1 - len(wr) / greatest(len(wh), 1)) end)"
    return f"case when len(wr) = 0 or len(wh) = 0 or wr_o1 = 0 then 0.0 else {bp} * exp({' + '.join(terms)}) end"


def scores_sql(select: str, with_lcs: bool) -> str:
    """``select`` over scored(pair_id, rt, ht, wr, wh, overlaps, lcs)."""
    lcs = """
    dp as (
      select k, rt, ht, 0 as i, list_transform(range(0, len(ht) + 1), lambda x: 0::bigint) as line from stemmed
      union all
      select k, rt, ht, i + 1, list_concat([0::bigint], list_transform(range(1, len(ht) + 1), lambda e: list_max(
               list_transform(range(1, e + 1), lambda j: case when ht[j] = rt[i + 1] then line[j] + 1 else line[j + 1] end))))
      from dp where i < len(rt)),
    lcs as (select k, line[len(ht) + 1] as lcs from dp where i = len(rt)),""" if with_lcs else "lcs as (select k, 0 as lcs from stemmed),"
    return f"""with recursive pairs as ({VIEWS['pairs']}),
    tok as (select row_number() over () as k, pair_id, {_rouge_words_sql('reference')} as r0, {_rouge_words_sql('hypothesis')} as h0,
                   {_words_sql('reference')} as wr, {_words_sql('hypothesis')} as wh from pairs),
    flat as (select k, 0 as side, unnest(r0) as token, unnest(range(len(r0))) as i from tok
             union all select k, 1 as side, unnest(h0) as token, unnest(range(len(h0))) as i from tok),
    {stem_ctes('flat')},
    side as (select k, side, list(stem order by i) as t from flat join stems using (token) group by k, side),
    stemmed as (select tok.k, pair_id, wr, wh, coalesce(a.t, []) as rt, coalesce(b.t, []) as ht from tok
                left join (select k, t from side where side = 0) a on a.k = tok.k left join (select k, t from side where side = 1) b on b.k = tok.k),
    {lcs}
    scored as (select *, {_overlap_sql([1, 2], 'rt', 'ht')}, {_overlap_sql([1, 2, 3, 4], 'wr', 'wh')} from stemmed join lcs using (k))
    {select}"""


R1 = f"round({_f1_sql('rt_o1', _count('rt', 1), _count('ht', 1))}, 6)"
R2 = f"round({_f1_sql('rt_o2', _count('rt', 2), _count('ht', 2))}, 6)"
RL = f"round({_f1_sql('lcs', 'len(rt)', 'len(ht)')}, 6)"
BLEU = f"round({_bleu_sql()}, 6)"


@register("rouge_n", scores_sql(f"select pair_id, {R1} as rouge1_f1, {R2} as rouge2_f1 from scored", False))
def rouge_n(spark, sf):
    return round_doubles(metrics.rouge_n(derived.score_pairs(spark, sf)))


@register("bleu", scores_sql(f"select pair_id, {BLEU} as bleu from scored", False))
def bleu(spark, sf):
    return round_doubles(metrics.bleu(derived.score_pairs(spark, sf)))


register("rouge_n_stem", scores_sql(f"select pair_id, {R1} as rouge1_f1, {R2} as rouge2_f1 from scored", False))(rouge_n)


@register("rouge_l", scores_sql(f"select pair_id, {RL} as rougeL_f1 from scored", True))
def rouge_l(spark, sf):
    return round_doubles(metrics.rouge_l(derived.score_pairs(spark, sf)))


register("rouge_l_stem", scores_sql(f"select pair_id, {RL} as rougeL_f1 from scored", True))(rouge_l)


@register("per_sample_scores", scores_sql(f"select pair_id, {R1} as rouge1_f1, {R2} as rouge2_f1, {RL} as rougeL_f1, {BLEU} as bleu from scored", True))
def per_sample_scores(spark, sf):
    return round_doubles(metrics.per_sample_scores(derived.score_pairs(spark, sf)))


@register("evaluate_responses", scores_sql(
    f"""select round(avg({_f1_sql('rt_o1', _count('rt', 1), _count('ht', 1))}), 6) as rouge1_f1, round(avg({_f1_sql('rt_o2', _count('rt', 2), _count('ht', 2))}), 6) as rouge2_f1,
               round(avg({_f1_sql('lcs', 'len(rt)', 'len(ht)')}), 6) as rougeL_f1, round(avg({_bleu_sql()}), 6) as bleu_score,
               count(*) as num_scored, (select count(*) from conversations) as num_samples from scored""", True))
def evaluate_responses(spark, sf):
    """Means over the scored pairs; ``num_samples`` counts every reference
    turn, including those without a hypothesis (no next conversation turn)."""
    refs = table(spark, sf, "conversations").select("conv_id", "turn")
    return round_doubles(metrics.evaluate_responses(derived.score_pairs(spark, sf), references=refs))


# White-space words, their types and the abbreviations among them (see operators/sentences.py).
_SPACED = lambda x: f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_BARE = lambda w: f"regexp_replace({w}, '^[^\\p{{L}}\\p{{N}}.]+|[^\\p{{L}}\\p{{N}}.]+$', '', 'g')"
_STOP = lambda b: f"regexp_matches({b}, '[^.]\\.$')"
_TYPE = lambda b: f"(case when {_STOP(b)} then regexp_replace({b}, '\\.$', '') else {b} end)"


def _abbreviation_ctes(source: str, text: str) -> str:
    return f"""
    aw as (select unnest({_SPACED(text)}) as w0 from {source}),
    ab as (select {_BARE('w0')} as b from aw where {_BARE('w0')} <> ''),
    ac as (select {_TYPE('b')} as type, count(*) filter ({_STOP('b')}) as p, count(*) filter (not {_STOP('b')}) as q from ab group by 1),
    share_of as (select sum(p)::double / sum(p + q) as share from ac),
    al as (select type, p, q, length(replace(type, '.', ''))::double as letters, length(type) - length(replace(type, '.', '')) + 1 as stops,
                  2 * (p * (ln(0.99::double) - ln(share)) + q * (ln((1 - 0.99::double)) - ln(1 - share))) as r
           from ac, share_of where p > 0 and share < 1 and regexp_matches(type, '\\p{{L}}')),
    abbr as (select type as abbreviation, p as with_stop, q as without_stop, r * exp(-letters) * stops * pow(letters, -q::double) as score from al
             where r * exp(-letters) * stops * pow(letters, -q::double) >= 0.3)"""


def _sentence_words_sql(x: str) -> str:
    word = f"case when {_STOP(_BARE('w'))} and i < len(ws) and list_contains(names, {_TYPE(_BARE('w'))}) then regexp_replace(w, '\\.([^\\p{{L}}\\p{{N}}.]*)$', '\ue000\\1') else w end"
    joined = f"(select array_to_string(list_transform(ws, lambda w, i: {word}), ' ') from (select {_SPACED(x)} as ws))"
    return f"list_transform({_words_sql(joined)}, lambda t: replace(t, '\ue000', '.'))"


@register("sentence_abbreviations", f"with {_abbreviation_ctes('documents', 'text')} select abbreviation, with_stop, without_stop, round(score, 6) as score from abbr")
def sentence_abbreviations(spark, sf):
    """Abbreviations learned from the documents."""
    return round_doubles(sentences.abbreviations(table(spark, sf, "documents"), "text"))


@register("bleu_sentences", f"""with pairs as ({VIEWS['pairs']}), {_abbreviation_ctes('conversations', 'text')},
    named as (select coalesce(list(abbreviation), []) as names from abbr),
    tok as (select pair_id, {_sentence_words_sql('reference')} as wr, {_sentence_words_sql('hypothesis')} as wh from pairs, named),
    scored as (select *, {_overlap_sql([1, 2, 3, 4], 'wr', 'wh')} from tok)
    select pair_id, {BLEU} as bleu from scored""")
def bleu_sentences(spark, sf):
    """BLEU with full stops split off at sentence ends only; abbreviations are
    learned from all turns."""
    learned = sentences.abbreviations(table(spark, sf, "conversations"), "text")
    return round_doubles(metrics.bleu(derived.score_pairs(spark, sf), learned))
