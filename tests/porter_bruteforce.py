"""A plain stemmer for tests, from the published description: letters are
classed as c(onsonant) or v(owel) first, and conditions look at the classes."""

import re

OWN = {"skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "innings": "inning", "outings": "outing", "cannings": "canning"}
UNCHANGED = {"sky", "news", "inning", "outing", "canning", "howe", "proceed", "exceed", "succeed"}
PAIRS = {2: "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
            "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful", 3: "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"}
LAST = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def classes(word):
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(word):
    return len(re.findall("v+c", classes(word)))


def short_end(word):
    k = classes(word)
    return (k.endswith("cvc") and word[-1] not in "wxy") or k == "vc"


def swap(word, table, at_least):
    for suffix, new in table:
        if word.endswith(suffix):
            rest = word[:-len(suffix)]
            fits = measure(rest) >= at_least and (suffix != "ion" or rest[-1:] in ("s", "t"))
            return rest + new if fits else word
    return word


def stem(word):
    if word in OWN or word in UNCHANGED:
        return OWN.get(word, word)
    w = word
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        cut = re.sub("(ed|ing)$", "", w)
        if cut != w and "v" in classes(cut):
            w = cut
            if re.search("(at|bl|iz)$", w):
                w += "e"
            elif w[-1:] == w[-2:-1] and classes(w).endswith("cc"):
                w = w if w[-1] in "lsz" else w[:-1]
            elif measure(w) == 1 and short_end(w):
                w += "e"
    if w.endswith("y") and len(w) > 2 and classes(w[:-1]).endswith("c"):
        w = w[:-1] + "i"
    table = {k: [tuple(x.split(":")) for x in v.split()] for k, v in PAIRS.items()}
    if w.endswith("alli") and measure(w[:-4]):
        w = w[:-2]
    w = (w[:-1] if measure(w[:-3]) else w) if w.endswith("logi") else swap(w, table[2], 1)
    w = swap(swap(w, table[3], 1), [(s, "") for s in LAST], 2)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
