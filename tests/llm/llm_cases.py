"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, kept boolean, doc string, n long, text_key long, gone string, spans string, w string, root long, part int, piece int"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _prose(rng: random.Random, n: int, words: list[str]) -> str:
    out = []
    for _ in range(n):
        out.append(rng.choice(words) + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def texts(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    en = ["river", "stone", "Their", "what", "which", "walking", "house", "the", "with", "bright", "seven", "thought"]
    fr = ["être", "garçon", "où", "Mère", "voilà", "leçon", "château", "avec", "déjà", "très", "fenêtre"]
    words = en + fr + [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
    base = [_prose(rng, n, words) for n in (3, 4, 5, 12, 13, 60, 120, 400, 900)]
    passage = _prose(rng, 70, words).replace("\n", " ")
    near = base[7].split(" ")
    near[10] = "changed"
    out: list[str | None] = [None, "", "   ", "\n\n", "a", "É", "42", "...", "no letter \u00a0 here", "tab\tand\x0bvertical\x0c\r\nline", "nul\x00byte \x01 \x02 marks a@b.co", "  double  spaces   here \n\n\n end  "]
    out += base + [base[7], base[7], " ".join(near), base[8] + " tail", passage + "\n" + base[5], "x\n" + passage + "\ny z", passage]
    out += ["\n".join(["same line here"] * 30), "ab" * 3000, "word " * 4000, "### $$$ %%% " * 40, _prose(rng, 15_000, words)]
    out += ["Mail first.last@mail.example.com, ip 10.0.0.255 or 1.2.3.456, card 4111 1111 1111 1111 and +1 (234) 555-0199 x",
            'key token = "9fceb02d0ae598e95dc970b74767f19372d61af8" end', "a@b.c_d@e.f 1.2.3.4.5 +49 30 1234567890123 4111-1111-1111-1112 é 000.001.02.3",
            "€€€ ½ … １２３ 😀 \u0301", "…ж…"]
    return out


def rows(seed: int = 7) -> list[tuple]:
    out = []
    for i, t in enumerate(texts(seed)):
        lang, source = [("en", "a"), ("fr", "a"), (None, "b"), ("en", None)][i % 4]
        out.append((i * 3 + 5, t, lang, source, None if t is None else len(t), -1, i, True, "d", 2, 3, "g", "s", "w", 1, 2, 3))
    return out


def table(spark, seed: int = 7, null_ids: bool = False, repeats: bool = False):
    data = rows(seed)
    if null_ids:
        data += [(None, *data[k][1:]) for k in (18, 19, 3)]
    if repeats:
        data += [data[20], data[20], data[1]]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def white_words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def alnum_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = white_words((text or "").translate(_LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_groups(docs: list[tuple]) -> list[set[int]]:
    """Groups of positions in ``docs`` (id, text) linked at 75 percent."""
    sets = [shingles(t) for _, t in docs]
    shared: collections.Counter = collections.Counter()
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a + 1, len(h)):
                shared[h[a], h[b]] += 1
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(set)
    for i in range(len(docs)):
        groups[find(i)].add(i)
    return list(groups.values())


def cut_repeats(texts_: list[str | None], length: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept sha256) of every text."""
    data = [(t or "").encode() for t in texts_]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        upto = 0
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                for j in range(max(i, upto), i + length):
                    gone[j] = 1
                upto = i + length
        runs = sum(1 for j in range(len(d)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def contamination(text: str | None, items: list[tuple]) -> tuple:
    """(n_words, n_hit, sorted item ids, contaminated)."""
    w, hit, ids = alnum_words(text), set(), set()
    for item, t in items:
        x = alnum_words(t)
        n = min(13, len(x))
        windows = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    def holds(kind: str, m: str) -> bool:
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def deduped_lines(docs: list[tuple], min_words: int = 50, max_lines: int = 8) -> list[set[int]]:
    """Lines to delete of every (id, text), ids ascending: in a run of whole
    lines with min_words words or max_lines lines that stands earlier."""
    lined = [[] if t is None else t.split("\n") for _, t in docs]
    first: dict[tuple, tuple] = {}
    found = []
    for d, ls in enumerate(lined):
        counts = [len(white_words(x)) for x in ls]
        for i in range(len(ls)):
            for n in range(1, min(max_lines, len(ls) - i) + 1):
                if n == max_lines or sum(counts[i:i + n]) >= min_words:
                    key = tuple(ls[i:i + n])
                    first[key] = min(first.get(key, (d, i)), (d, i))
                    found.append((key, d, i))
    gone: list[set[int]] = [set() for _ in docs]
    for key, d, i in found:
        if first[key] < (d, i):
            gone[d] |= set(range(i, i + len(key)))
    return gone
