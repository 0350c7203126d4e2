"""Personal data by weak supervision (DataFrame expressions only).

1. Base spans: e-mail, IP address, payment card and phone patterns with their
   checks, all of which stay.  Further candidates touch no base span: unbroken,
   hyphenated or base64 tokens of eight or more characters that hold a digit;
   six or more digits in groups (also an account number's, with letters); any
   token, or quoted text, after an asked-for word and ``:`` or ``=``.
2. Labelers vote on every span (yes, no, abstain): the patterns, two word lists
   (gazetteers), the characters around it, its shape, its variety.
3. Expectation-maximisation over the counts of vote patterns (at most 3^5,
   whatever the corpus) estimates each labeler's reliability and so the
   probability of every pattern.
4. A naive Bayes classifier over span features, trained on all spans weighted
   by those probabilities, decides on the further candidates; the accepted ones
   that lie in no wider accepted one are added with kind ``other``.

Null or empty text: no span.  A text's spans come from that row alone, so
repeated rows and null ids do no harm.  Very long texts are read whole; places
are added up in chunks, so that work grows nearly linearly with a text's spans.
No span in the corpus: nothing added.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import named
from corpuskit.session import materialize

CHUNK = 256  # spans whose places are added up together
KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
_SPAN = "array<struct<kind:string,lo:int,hi:int,match:string,before:string,after:string>>"
_ON, _OFF = "\u0001", "\u0002"

# Word lists (fixed values).
ASKED = ("account", "address", "api", "auth", "card", "email", "fax", "iban", "key", "login", "mail", "mobile", "passport", "password", "phone", "secret", "ssn", "tel", "token", "user")
UNITS = ("%", "cm", "days", "eur", "hours", "kb", "kg", "km", "mb", "mm", "px", "times", "usd", "years")
COUNTED = ("chapter", "fig", "isbn", "line", "no", "page", "section", "table", "version", "vol")

# A short number, or one of a card's length that fails the card's check.
UNCHECKED = "^[0-9]{1,10}$|^[0-9](?:[ -]?[0-9]){12,18}$"

# What joins two groups of digits, and an asked-for word with what stands after it.
_JOIN = r"(?: [-/] | ?[(\[]|[)\]][ ./-]?[(\[]?|[ ./-])"
_AFTER_ASKED = rf"(?<=(?<![A-Za-z0-9])(?i:{'|'.join(ASKED)})[\"']? {{0,2}}[:=]{{1,2}}>? {{0,2}}[\"']?)"

# Possessive forms of the contract's patterns: the same matches, without
# backtracking or recursion over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    OTHER: r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{8,}+",
    "joined": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?:[A-Za-z0-9_+/-]|(?<=[0-9+/])=|={1,2}(?![A-Za-z0-9_=])){8,}+",
    "groups": rf"(?<![A-Za-z0-9_])(?:[A-Z]{{2}}[0-9]{{2}}(?:(?: ?[A-Z]{{4}})?+ ?[0-9A-Z]{{0,3}}[0-9][0-9A-Z]{{0,3}})++|[(\[]?[0-9]++(?:{_JOIN}[0-9]++)++)",
    "asked": rf"{_AFTER_ASKED}(?![:=>])(?:(?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|(?:(?![,;&][A-Za-z_][A-Za-z0-9_.-]*+[:=])(?![.,;:)\]}}]{{1,4}}(?:[\s\"'<>]|\z))[^\s\"'<>])++)",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MORE = (OTHER, "joined", "groups", "asked")  # patterns of the further candidates, all of kind other


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, op) -> Column:
    """Running ``op`` (sum, greatest or least) over an array of whole numbers,
    its own value included.  Appending to an array copies it, so values are
    carried on within chunks of ``CHUNK`` and over the chunks' last values:
    the work stays nearly linear in texts of very many spans."""
    def carried(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(op(F.coalesce(F.get(acc, F.size(acc) - 1), zero), v))))

    def chunked(vs: Column) -> Column:
        count = F.floor((F.size(vs) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda c: carried(F.slice(vs, c * CHUNK + 1, F.lit(CHUNK))))

    def joined(runs: Column) -> Column:
        tops = carried(F.transform(runs, lambda r: F.element_at(r, -1)))
        return _bound(tops, lambda ts: F.flatten(F.transform(runs, lambda r, c: F.transform(r, lambda x: op(F.coalesce(F.get(ts, c - 1), zero), x)))))

    return _bound(values, lambda vs: F.when(F.size(vs) == 0, F.array().cast("array<int>")).otherwise(F.when(F.size(vs) <= CHUNK, carried(vs)).otherwise(_bound(chunked(vs), joined))))


def _found(text: Column, kind: str) -> Column:
    """All leftmost, non-overlapping matches, with their place in code points:
    matches are put between two marks and the text is cut at the marks."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_ON}$0{_OFF}"), _ON)
    rest = lambda x: F.substring_index(x, _OFF, -1)  # noqa: E731  (all of the first part, which has no mark)

    def spans_of(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x, i: F.length(x) - F.when(i == 0, 0).otherwise(1))

        def placed(ends: Column) -> Column:
            def span(i: Column) -> Column:
                x, lo = F.get(parts, i), F.get(ends, i - 1)
                match = F.substring_index(x, _OFF, 1)
                return F.struct(F.lit(OTHER if kind in MORE else kind).alias("kind"), lo.alias("lo"), (lo + F.length(match)).alias("hi"), match.alias("match"),
                                F.right(rest(F.get(parts, i - 1)), F.lit(24)).alias("before"), F.substring(rest(x), 1, 8).alias("after"))
            return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), span)

        return _bound(running(sizes, F.lit(0), lambda a, x: a + x), placed)

    spans = _bound(parts, lambda ps: F.when(F.size(ps) > 1, spans_of(ps)).otherwise(F.array().cast(_SPAN)))
    need = NEEDS.get(kind)
    return F.when(text.contains(need) if need else text.rlike("[:=]" if kind == "asked" else "[0-9]"), spans).otherwise(F.array().cast(_SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((total["n"] + F.when(total["odd"], twice).otherwise(d)).alias("n"), (~total["odd"]).alias("odd"))

    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(each, F.struct(F.lit(0).alias("n"), F.lit(False).alias("odd")), step, lambda t: t["n"] % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            value = F.ltrim(part, F.lit("0"))
            return F.when(F.length(value) == 0, True).when(F.length(value) > 3, False).otherwise(F.substring(value, 1, 3).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "groups":
        return F.length(_digits(match)) >= 6  # the labelers vote against fewer
    return F.lit(True)


def _holds(kind: str, s: Column) -> Column:
    return _valid(kind, s["match"])


def _in_order(spans: Column) -> Column:
    """By start, the widest first of those that start together."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), (-s["hi"]).alias("hi"), s.alias("s")))), lambda x: x["s"])


def _differing(spans: Column) -> Column:
    """Spans in order; of those with one place, the first."""
    def first(s: Column, i: Column, arr: Column) -> Column:
        last = F.get(arr, i - 1)
        return F.coalesce((last["lo"] != s["lo"]) | (last["hi"] != s["hi"]), F.lit(True))

    return F.element_at(F.transform(F.array(_in_order(spans)), lambda arr: F.filter(arr, lambda s, i: first(s, i, arr))), 1)


def _outermost(spans: Column) -> Column:
    """Spans in order, without those that lie in another one."""
    def kept(arr: Column) -> Column:
        far = running(F.transform(arr, lambda s: s["hi"]), F.lit(-1), F.greatest)
        return _bound(far, lambda ends: F.filter(arr, lambda s, i: F.coalesce(s["hi"] > F.get(ends, i - 1), F.lit(True))))

    return _bound(_in_order(spans), kept)


def _free(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``, by one sweep over both in order:
    the farthest end of a base span before, and the nearest start of one after."""
    far, none = F.lit(-1), F.lit(2_147_483_647)
    item = lambda s, own: F.struct(s["lo"].alias("lo"), F.lit(own).alias("own"), (-s["hi"]).alias("hi"), s.alias("s"))
    items = F.array_sort(F.concat(F.transform(base, lambda s: item(s, 0)), F.transform(spans, lambda s: item(s, 1))))

    def swept(arr: Column) -> Column:
        ends = running(F.transform(arr, lambda x: F.when(x["own"] == 0, -x["hi"]).otherwise(far)), far, F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(arr, lambda x: F.when(x["own"] == 0, x["lo"]).otherwise(none))), none, F.least))
        free = lambda x, i, e, s: (x["own"] == 1) & (F.get(e, i) <= x["lo"]) & (F.get(s, i) >= -x["hi"])
        return F.transform(_bound(ends, lambda e: _bound(starts, lambda s: F.filter(arr, lambda x, i: free(x, i, e, s)))), lambda x: x["s"])

    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(_bound(items, swept))


def of_kind(kind: str, s: Column) -> Column:
    return s["kind"] == kind


def find_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns, ``base`` (by kind, then start) and ``more`` (the
    further candidates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.when(text.rlike(f"[{_ON}{_OFF}]"), F.translate(text, _ON + _OFF, "\u0003\u0003")).otherwise(text)  # marks of its own would shift places
    step = docs.select(F.struct(*named(carry)).alias("doc"), plain.alias("_t"))
    step = step.select("doc", *[_found(F.col("_t"), k).alias(k) for k in (*KINDS, *MORE)])
    held = lambda kinds: F.concat(*[F.filter(k, functools.partial(_holds, k)) for k in kinds])
    step = step.select("doc", held(KINDS).alias("base"), _differing(held(MORE)).alias(OTHER))
    return step.select("doc", "base", _free(F.col(OTHER), F.col("base")).alias("more"))


def _votes(span: Column) -> list[Column]:
    """One of 0 (no), 1 (abstain), 2 (yes) per labeler."""
    match, before, after = span["match"], F.lower(span["before"]), F.lower(span["after"])
    digits, distinct = F.length(_digits(match)), F.size(F.array_distinct(F.split(match, "")))
    vote = lambda yes, no: F.when(yes, 2).when(no, 0).otherwise(1)
    return [
        vote(span["kind"] != OTHER, match.rlike(UNCHECKED)),
        vote(before.rlike(rf"\b({'|'.join(ASKED)})\b[^a-z0-9]*$"), after.rlike(rf"^ ?({'|'.join(UNITS)})\b")),
        vote(before.rlike("[=:] ?[\"']?$"), before.rlike(rf"\b({'|'.join(COUNTED)})\b[. ]*$")),
        vote((digits >= 9) | match.rlike("^(?i)[0-9a-f]{16,}$"), digits <= 5),
        vote((F.length(match) >= 16) & (distinct >= 8), distinct <= 3),
    ]


LABELERS = 5
SURE, MOST = 0.99, 0.85  # reliability of the labeler that is right by construction; the most that another can earn, so that two do not outvote it


def _pattern(span: Column) -> Column:
    code = F.lit(0)
    for v in _votes(span):
        code = code * 3 + v
    return code


def _features(span: Column) -> list[Column]:
    """Small whole numbers (under 32) that describe a span."""
    match, before = span["match"], span["before"]
    n, digits = F.length(match), F.length(_digits(match))
    return [
        F.least(F.floor(n / 4), F.lit(31)).cast("int"),
        F.floor(8 * digits / n).cast("int"),
        F.when(match.rlike("^[0-9]+$"), 0).when(match.rlike("^[0-9a-fA-F]+$"), 1).when(match.rlike("^[A-Za-z0-9]+$"), 2).when(match.contains("@"), 3).otherwise(4),
        F.when(before.rlike("[\"'=:]$"), 0).when(before.rlike("[ \\n]$"), 1).when(F.length(before) == 0, 2).otherwise(3),
        F.least(F.size(F.array_distinct(F.split(match, ""))), F.lit(31)),
        F.when(F.lower(before).rlike(rf"\b({'|'.join(ASKED)})\b[^a-z0-9]*$"), 1).otherwise(0),
        F.when(match.rlike(UNCHECKED), 1).otherwise(0),
    ]


def reliabilities(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Probability of 'personal' for each vote pattern, by EM over the pattern
    counts.  A labeler has one reliability, the probability that a vote it
    gives is right; an abstention says nothing.

    What the classes mean is held fast, whatever is common in the corpus: the
    first labeler, which tells checked patterns from numbers that fail the
    check, is right by construction and keeps ``SURE``; a span of a base
    pattern is personal; and the others earn between one half and ``MOST``.
    """
    votes = {p: [p // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)] for p in counts}
    sure = {p for p, v in votes.items() if v[0] == 2}
    belief = {p: SURE if p in sure else (0.5 + v.count(2)) / (1.0 + v.count(2) + v.count(0)) for p, v in votes.items()}
    open_ = [(p, n) for p, n in counts.items() if p not in sure]  # base spans are in no doubt, so the prior is of the others
    for _ in range(rounds):
        prior = min(0.5, (1 + sum(n * belief[p] for p, n in open_)) / (2 + sum(n for _, n in open_)))  # never a vote for
        right, given = [1.0] * LABELERS, [2.0] * LABELERS
        for (p, n), j in itertools.product(counts.items(), range(LABELERS)):
            if votes[p][j] != 1:
                right[j] += n * (belief[p] if votes[p][j] == 2 else 1 - belief[p])
                given[j] += n
        weight = [math.log(SURE / (1 - SURE))] + [min(math.log(MOST / (1 - MOST)), max(0.0, math.log(right[j] / max(given[j] - right[j], 1e-9)))) for j in range(1, LABELERS)]
        for p, _ in open_:
            odds = math.log(prior / (1 - prior)) + sum(w * (v - 1) for w, v in zip(weight, votes[p]))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def _lookup(values: dict[int, float], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), key), F.lit(0.0))


def detect(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``doc`` (the carried columns), ``base`` and ``added`` spans: arrays of
    kind, lo, hi (code points, end exclusive), match and its surroundings."""
    found = materialize(find_spans(docs, carry), "spans")
    spans = found.select(F.explode(F.concat("base", "more")).alias("s"))
    counts = {r["p"]: r["n"] for r in spans.groupBy(_pattern(F.col("s")).alias("p")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return found.select("doc", "base", F.array().cast(_SPAN).alias("added"))
    belief = reliabilities(counts)
    # the classifier decides on further candidates, and those train it
    open_ = spans.where(F.col("s.kind") == OTHER)
    parts = F.explode(F.array(*[32 * j + f for j, f in enumerate(_features(F.col("s")))]))
    trained = open_.select("s", _lookup(belief, _pattern(F.col("s"))).alias("w")).select("w", parts.alias("f")).groupBy("f").agg(F.sum("w").alias("yes"), F.sum(1 - F.col("w")).alias("no")).collect()
    asked = [(n, belief[p]) for p, n in counts.items() if p // 3 ** (LABELERS - 1) != 2]
    yes = sum(n * b for n, b in asked)
    no = sum(n for n, _ in asked) - yes
    weight = {r["f"]: math.log((r["yes"] + 1) / (yes + 32)) - math.log((r["no"] + 1) / (no + 32)) for r in trained}
    prior = math.log((yes + 1) / (no + 1))

    def accepted(span: Column) -> Column:
        score = F.lit(prior)
        for j, f in enumerate(_features(span)):
            score = score + _lookup(weight, 32 * j + f)
        return score >= 0

    return found.select("doc", "base", _outermost(F.filter("more", accepted)).alias("added"))


def told(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")
