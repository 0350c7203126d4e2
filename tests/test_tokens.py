from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuskit.operators import tokens
from corpuskit.sources.tables import table


def _vocab(spark):
    return spark.createDataFrame([("a", 5, 1), ("b", 6, 1), ("c", 7, 1)], "token string, id int, count long")


def test_encode_golden(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c a b c z"), (3, "")], "k long, t string")
    rows = {r.k: r for r in tokens.encode(df, "t", _vocab(spark), ["k"], max_length=5, pad_id=0).collect()}
    assert rows[1].input_ids == [5, 6, 7, 0, 0]
    assert rows[1].attention_mask == [1, 1, 1, 0, 0]
    assert rows[1].labels == [5, 6, 7, -100, -100]
    assert rows[2].input_ids == [5, 6, 7, 5, 6] and rows[2].n_tokens == 7
    assert rows[3].input_ids == [0] * 5 and rows[3].attention_mask == [0] * 5


def test_unknown_and_collator_labels(spark):
    df = spark.createDataFrame([(1, "a zz <eos>")], "k long, t string")
    enc = tokens.encode(df, "t", _vocab(spark).unionByName(
        spark.createDataFrame([("<eos>", tokens.EOS, 0)], "token string, id int, count long")),
        ["k"], max_length=4)
    r = enc.first()
    assert r.input_ids == [5, tokens.UNK, tokens.EOS, tokens.EOS]
    assert r.labels == [5, tokens.UNK, tokens.EOS, -100]
    assert tokens.collator_labels(enc).first().labels == [5, tokens.UNK, -100, -100]


def test_vocab_order_and_mask_property(spark):
    docs = table(spark, SF_SMALL, "documents")
    v = tokens.vocab(docs, "text", 100)
    rows = v.orderBy("id").collect()
    assert [r.token for r in rows[:4]] == tokens.SPECIALS
    counts = [r["count"] for r in rows[4:]]
    assert counts == sorted(counts, reverse=True) and len(rows) == 104
    enc = tokens.encode(docs, "text", v, ["doc_id"], max_length=32)
    bad = enc.filter(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x) != F.least("n_tokens", F.lit(32)))
    assert bad.count() == 0 and enc.count() == docs.count()


def test_batches_cover_every_row_once(spark):
    docs = table(spark, SF_SMALL, "documents")
    enc = tokens.encode(docs, "text", tokens.vocab(docs, "text", 50), ["doc_id"], max_length=8)
    b = tokens.batches(enc, "doc_id", batch_size=16, shards=4)
    keys = [k for r in b.collect() for k in r.keys]
    assert sorted(keys) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert max(len(r.keys) for r in b.collect()) <= 16


def test_render_chat(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", "hello")],
                               "conv_id long, turn long, role string, text string")
    r = tokens.render_chat(df).first()
    assert r.chat == ("<start_of_turn>user\nhello<end_of_turn>\n"
                      "<start_of_turn>assistant\nhi<end_of_turn>\n")
    assert r.turns == 2


def test_rows_of_one_key_stay_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (1, "c a"), (1, "a b"), (2, "")], "k long, t string")
    want = [(1, [5, 6, 0]), (1, [5, 6, 0]), (1, [7, 5, 0]), (2, [0, 0, 0])]
    for limit in (10, 0):  # looked up in the row, and joined
        monkeypatch.setattr(tokens, "LOOKUP_VOCAB_ROWS", limit)
        got = tokens.encode(df, "t", _vocab(spark), ["k"], max_length=3, pad_id=0).collect()
        assert sorted((r.k, r.input_ids) for r in got) == want
