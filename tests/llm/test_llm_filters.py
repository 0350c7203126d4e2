"""Language, quality, URL and personal-data operators."""

import collections
import re

import llm_cases as C
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import quality
from corpuskit.llm.langid import identify, train
from corpuskit.llm.pii import KINDS, detect, find_spans, reliabilities, running, told
from corpuskit.llm.queries import QUERIES, URL_RULES
from corpuskit.llm.urls import build_digest_array, filter_urls, probe

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = QUERIES["op2_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    docs = C.table(spark, null_ids=True, repeats=True)
    model = train(docs)
    got = identify(docs, [c for c in docs.columns if c != "text"], model).withColumn("t", F.lit(1)).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    text = {r[0]: r[1] for r in C.rows()}
    for i, t in text.items():
        assert (by[i] == "und") == (t is None or not any(map(str.isalpha, t)))
    assert identify(C.empty(spark), ["doc_id"], model).count() == 0
    nothing = train(C.empty(spark))
    assert {r["lang_pred"] for r in identify(docs, ["doc_id"], nothing).collect()} == {"und"}


def test_language_of_a_hundred_labels_matches_brute_force(spark):
    """More labels than one 64-bit mask holds; every label has its own letters,
    and shares are those of exact sets (the filter is corrected for chance)."""
    import itertools
    import random

    rng = random.Random(2)
    pairs = list(itertools.combinations("abcdefghijklmnopqrst", 3))[:100]
    prose = lambda k, n: " ".join("".join(rng.choice(pairs[k]) for _ in range(rng.randrange(3, 8))) for _ in range(n))
    labelled = [(prose(k, 400), f"l{k:03d}") for k in range(100)] + [(prose(7, 1), "few")]
    model = train(spark.createDataFrame(labelled, "text string, lang string"))
    assert len(model[0]) == 101 and model[1].shape[0] == 2
    asked = [(k, prose(k, 40)) for k in range(100)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(asked, "doc_id long, text string"), ["doc_id"], model).collect()}

    def grams(text):
        t = f"{text}"
        return [t[i:i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]

    seen = {lang: collections.Counter(g for text, x in labelled if x == lang for g in grams(text)) for lang in model[0]}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in seen.items()}
    best = collections.Counter()
    for r in rate.values():
        for g, x in r.items():
            best[g] = max(best[g], x)
    sets = {lang: {g for g, x in r.items() if x >= 1e-5 and x >= 0.25 * best[g]} for lang, r in rate.items()}
    for k, text in asked:
        mine = grams(text)
        want = max(sum(g in s for g in mine) / len(mine) for s in sets.values())
        assert got[k]["score"] == pytest.approx(want, abs=0.02) and got[k]["lang_pred"] == f"l{k:03d}"


def counts(text):
    t = text or ""
    w = C.white_words(t)
    triples = collections.Counter(zip(w, w[1:], w[2:]))
    again = {i + d for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if C.white_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark):
    docs = C.table(spark, null_ids=True, repeats=True)
    got = quality.judge(docs, docs.columns)
    source = collections.Counter((r["doc_id"], *counts(r["text"])) for r in docs.collect())
    rows = got.collect()
    assert collections.Counter((r["doc"]["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == source
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(C.empty(spark), ["doc_id"]).count() == 0


def test_quality_limits_follow_the_group(spark):
    """A source that is full of symbols by nature keeps its usual documents;
    the same documents are rejected in a clean source."""
    plain = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}" + ("#" if i % 3 == 0 else "") for i in range(80))
    data = [(i, plain, "en", "plain") for i in range(300)] + [(1000 + i, marked, "en", "code") for i in range(300)] + [(2000, marked, "en", "plain"), (2001, marked, "en", "rare")]
    got = {r["doc"]["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300)) and not got[2000]
    assert got[2001]  # a small group uses its language's sketch, whose median is between


def test_quality_has_no_step_in_the_size_of_a_group(spark):
    """A symbol-rich clean source beside a plain one of its language: its
    documents stay at 199 and at 200 documents alike."""
    plain = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}" + ("#" if i % 3 == 0 else "") for i in range(80))
    for n in (199, 200):
        data = [(i, plain, "en", "plain") for i in range(1000)] + [(2000 + i, marked, "en", "code") for i in range(n)]
        got = quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), ["doc_id"])
        assert got.where("kept").count() == 1000 + n


def test_quality_limits_differ_and_keep_labelled_documents(spark):
    told = quality.limits(quality.measure(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id"])).collect()
    for m in ("repeat_pm", "word_len_pc"):
        assert len({r[f"high_{m}"] for r in told}) > 10
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, ["doc_id"]).select("doc.doc_id", "base_failed", "kept").join(labels, "doc_id").where("not base_failed")
    by = {(r["quality"], r["kept"]): r["n"] for r in judged.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert by.get((1, False), 0) == 0 and by[1, True] > 3000 and by.get((0, True), 0) == 0 and by[0, False] > 200


def test_sketches_merge_by_adding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = quality.measure(docs, ["doc_id"]).persist()
    parts = [quality.sketches(one.where(F.col("doc.doc_id") % 2 == k)) for k in (0, 1)]
    merged = parts[0].union(parts[1]).groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))
    key = lambda df: sorted(map(tuple, df.select("lang", "source", "metric", "bucket", "n").collect()))
    assert key(merged) == key(quality.sketches(one))


@pytest.mark.parametrize("value,want", [(0, 0), (1, 1), (1023, 1023), (1024, 1024), (1025, 1024), (123_456_789, 123_456_789 >> 17 << 17)])
def test_bucket(spark, value, want):
    assert spark.range(1).select(quality.bucket(F.lit(value).cast("long")).alias("b")).first()["b"] == want


URLS = [None, "", "no scheme", "http://", "https://A.Example.NET", "https://a.example.net/", "http://net/en/", "http://example.net/en/1", "http://x.example.net/en/", "http://xexample.net/en/", "http://sub.example.com/de/7?x=1#f",
        "ftp://ORG/fr/", "http://a.org/fr", "http://a.org/fr/x/../y", "http://b.net?x://c.org/fr/", "x://y://net/", "http://é.net/ü", "//net/", "http://a.net#/en/", "http://example.com:80/de/"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(C._LOW)
    fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[6], "", "")], "page_id long, url string, rule string, host string")
    got = filter_urls(pages, URL_RULES).collect()
    assert sorted((repr(r["page_id"]), r["host"], r["path"], repr(r["rule"]), r["verdict"]) for r in got) == sorted(
        (repr(i), h, p, repr(r), v) for i, u in [*enumerate(URLS), (None, URLS[6])] for h, p, r, v in [brute(u, URL_RULES)])
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, [], default="block").collect()} == {"block"}


def test_urls_match_brute_force_over_many_shards(spark, monkeypatch):
    from corpuskit.llm import urls

    build, built = urls.build_digest_array, []
    monkeypatch.setattr(urls, "SHARD_ROWS", 100)
    monkeypatch.setattr(urls, "build_digest_array", lambda listed: built.append(build(listed)) or built[0])
    rules = [(("block", "allow")[i % 2], f"host{i}.net/{'p/' * (i % 3)}") for i in range(2000)]
    asked = [f"http://{'www.' * (i % 2)}host{i}.net/{'p/' * (i % 4)}x" for i in range(0, 4000, 13)]
    got = filter_urls(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), rules).collect()
    want = [(i, *brute(u, rules)) for i, u in enumerate(asked)]
    assert len(built[0]) >= 15 and 50 < sum(w[3] is not None for w in want) < len(want)
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want


def test_digest_collision_does_not_decide(spark, monkeypatch):
    from corpuskit.llm import urls

    listed = [f"host{i}.net/" for i in range(50)]
    shards = build_digest_array(spark.createDataFrame([(x,) for x in listed], "listed string"))
    assert probe(shards, [x.encode() for x in [*listed, "other.net/"]]).tolist() == [True] * 50 + [False]
    # every probe now collides with a stored digest: only the full string decides
    keys = urls._shard(shards[0])[0]
    monkeypatch.setattr(urls, "_digest", lambda strings: keys[[0] * len(strings)])
    got = probe(shards, [x.encode() for x in listed])
    assert got.sum() == 1


def test_personal_data_base_spans(spark):
    docs = C.table(spark, null_ids=True, repeats=True)
    text = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = collections.Counter((i, ",".join("%s:%d:%d" % s for s in C.base_spans(t))) for i, t in text)
    got = detect(docs, docs.columns).select(F.col("doc.doc_id").alias("doc_id"), told(F.col("base")).alias("base"), "added").collect()
    assert collections.Counter((r["doc_id"], r["base"]) for r in got) == want
    assert sum(bool(want_) for _, want_ in want) >= 2
    assert detect(C.empty(spark), ["doc_id"]).count() == 0
    assert detect(docs.where("text is null"), ["doc_id"]).first()["added"] == []


def test_personal_data_adds_secrets_and_leaves_words(spark):
    found = detect(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id", "text"]).select("doc.text", "base", "added").collect()
    secrets = kept = 0
    for r in found:
        held = [r["text"][s["lo"]:s["hi"]] for s in r["added"]]
        assert held == [s["match"] for s in r["added"]]
        for m in re.findall(r'token = "([0-9a-f]{40})"', r["text"]):
            secrets += 1
            kept += m in held
    assert secrets and kept == secrets
    assert set(KINDS) == {s["kind"] for r in found for s in r["base"]}


ASKED_FORMS = [("phone: ", "555-123-4567"), ("tel ", "(030) 123 4567"), ("ssn: ", "123-45-6789"), ("iban: ", "DE89 3704 0044 0532 0130 00"),
               ("password: ", "correct_horse_Battery"), ("passport: ", "C01X00T"), ("key: ", "123e4567-e89b-12d3-a456-426614174000"), ('key = "', "two words")]


def test_personal_data_candidates_are_whole(spark):
    forms = [*ASKED_FORMS, ("x ", "aB3/xY9+kQ2=Zz8/pL4"), ("IBAN ", "GB29 NWBK 6016 1331 9268 19"), ("user=bob&token=", "ab"), ("a@b.co 10.0.0.1 ", "12345678901")]
    docs = spark.createDataFrame([(i, f'Before. {b}{m}" and after.') for i, (b, m) in enumerate(forms)], "doc_id long, text string")
    for r in find_spans(docs, ["doc_id"]).collect():
        before, match = forms[r["doc"]["doc_id"]]
        lo = len(f"Before. {before}")
        assert (lo, lo + len(match), match) in {(s["lo"], s["hi"], s["match"]) for s in r["more"]}
        assert not any(s["lo"] < b["hi"] and b["lo"] < s["hi"] for s in r["more"] for b in r["base"])


MORE_FORMS = [*ASKED_FORMS, ("token: ", "aB3/xY9+kQ2=Zz8/pL4"), ("user: ", "bob_1984")]


@pytest.mark.parametrize("sf,n", [("sf0.01", 10), ("sf0.01", 100), ("sf0.01", 1000), ("sf0.1", 100)])
def test_personal_data_accepts_usual_forms_however_many(spark, sf, n):
    """Planted lines of ten forms, few or many: all are added, the corpus's own
    tokens stay, and numbers that fail the card check are left alone."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    forms = [MORE_FORMS[i % len(MORE_FORMS)] for i in range(n)]
    planted = [(-1 - i, f'Some words before this. {b}{re.sub("[0-9]", lambda d: str((int(d[0]) + i) % 10), m)}" and words after.', m) for i, (b, m) in enumerate(forms)]
    got = detect(docs.unionByName(spark.createDataFrame([p[:2] for p in planted], docs.schema)), ["doc_id", "text"]).select("doc.*", "added").collect()
    added = {r["doc_id"]: [s["match"] for s in r["added"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 0}
    hit = collections.Counter(m for i, t, m in planted if any(len(a) == len(m) and a in t for a in added[i]))
    assert hit == collections.Counter(m for _, m in forms)
    rest = [r for r in got if r["doc_id"] is None or r["doc_id"] >= 0]
    assert all(m in [s["match"] for s in r["added"]] for r in rest for m in re.findall(r'token = "([0-9a-f]{40})"', r["text"] or ""))
    assert not any(re.fullmatch("[0-9]{16}", s["match"]) for r in rest for s in r["added"])


def test_personal_data_of_very_many_spans(spark):
    text = " ".join(f"user{i}@mail.example.com id key: {i:09d}ab" for i in range(20_000))
    r = detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert [text[s["lo"]:s["hi"]] for s in r["base"]] == [f"user{i}@mail.example.com" for i in range(20_000)]
    assert [text[s["lo"]:s["hi"]] for s in r["added"]] == [f"{i:09d}ab" for i in range(20_000)]


@pytest.mark.parametrize("values", [[], [3], [1, -2, 5], list(range(-300, 700)), [7] * 513])
def test_running_values(spark, values):
    import itertools

    df = spark.createDataFrame([(values,)], "v array<int>")
    for zero, op, want in ((0, lambda a, x: a + x, sum), (-10**6, F.greatest, max), (10**6, F.least, min)):
        got = df.select(running(F.col("v"), F.lit(zero), op).alias("r")).first()["r"]
        assert got == [want(values[:i + 1]) for i in range(len(values))]
    assert list(itertools.accumulate(values)) == df.select(running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("r")).first()["r"]


def test_reliabilities_follow_the_agreeing_labelers():
    def code(*v):
        out = 0
        for x in v:
            out = out * 3 + x
        return out

    belief = reliabilities({code(1, 2, 2, 2, 1): 100, code(1, 0, 0, 0, 1): 300, code(1, 2, 0, 0, 1): 20, code(1, 1, 1, 1, 1): 5, code(2, 0, 0, 0, 1): 3, code(0, 1, 1, 2, 2): 500})
    assert belief[code(1, 2, 2, 2, 1)] > 0.7 and belief[code(1, 0, 0, 0, 1)] < 0.1 and belief[code(1, 2, 0, 0, 1)] < 0.5
    # what the first labeler tells is right by construction, however common the rest is
    assert belief[code(2, 0, 0, 0, 1)] == 0.99 and belief[code(0, 1, 1, 2, 2)] < 0.5
