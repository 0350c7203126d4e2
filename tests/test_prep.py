from pyspark.sql import functions as F

from corpuskit.operators import prep

Q_SCHEMA = "Id long, Title string, Body string, Score int"
A_SCHEMA = "Id long, ParentId long, Body string, Score int"
LONG = "<ul><li>Sort by key, then merge the runs</li><li>This keeps memory flat</li></ul>"


def test_a_pair_keeps_its_columns(spark):
    q = spark.createDataFrame([(7, "How to sort a large file?", "<p>Two runs of <i>sorted</i> lines</p>", 42)], Q_SCHEMA)
    a = spark.createDataFrame([(70, 7, LONG, 3)], A_SCHEMA)
    out = prep.build_qa_pairs(q, a)
    rows = out.collect()
    assert len(rows) == 1
    assert out.columns == prep.QA_COLUMNS
    assert rows[0].answer == "Sort by key, then merge the runs This keeps memory flat"
    assert rows[0].answer_score == 3  # no score filter inside pairing


def test_one_question_many_answers_and_length_filter(spark):
    q = spark.createDataFrame([(1, " \tT\n", "<p>Question body</p>", 10),
                               (2, "short", "<p>tiny</p>", 10)], Q_SCHEMA)
    a = spark.createDataFrame([(100, 1, LONG, 7), (101, 1, LONG.replace("This", "That"), 8),
                               (102, 1, "<p>too short</p>", 9), (103, 2, LONG, 9), (104, 3, LONG, 9)], A_SCHEMA)
    rows = prep.build_qa_pairs(q, a).collect()
    assert sorted(r.answer_score for r in rows) == [7, 8]
    assert {r.question_title for r in rows} == {"T"}  # tab/newline trimmed too


def test_score_filter_is_strict_and_drops_null(spark):
    q = spark.createDataFrame([(1, "a", "b", 5), (2, "a", "b", 6), (3, "a", "b", None)], Q_SCHEMA)
    assert [r.Id for r in prep.score_filter(q, 5).collect()] == [2]


def test_top_questions_ties_by_id(spark):
    q = spark.createDataFrame([(i, "t", "b", s) for i, s in [(5, 9), (3, 9), (4, 10), (1, 1)]], Q_SCHEMA)
    assert [r.Id for r in prep.top_questions(q, 3).collect()] == [4, 3, 5]


def test_load_qa_pairs_top_n(spark):
    q = spark.createDataFrame([(i, f"t{i}", "<p>Question body</p>", 10 + i) for i in range(5)], Q_SCHEMA)
    a = spark.createDataFrame([(100 + i, i, LONG, 9) for i in range(5)], A_SCHEMA)
    rows = prep.load_qa_pairs(q, a, min_score=5, max_samples=2).collect()
    assert sorted(r.question_title for r in rows) == ["t3", "t4"]


def test_render_prompt_and_training(spark):
    df = spark.createDataFrame([("T", "B", "A")], "question_title string, question_body string, answer string")
    assert prep.render_prompt(df).first().prompt == "Question: T\nB\nAnswer:"
    assert prep.render_training(df).first().text == "<bos>Question: T\nB\nAnswer: A<eos>"
    nulls = spark.createDataFrame([(None, "B", "A")], df.schema)
    assert prep.render_prompt(nulls).first().prompt == "Question: \nB\nAnswer:"


def test_count_contract(spark):
    p = spark.range(3)
    r = spark.range(4)
    row = prep.count_contract(p, r).first()
    assert (row.n_pred, row.n_ref, row.ok) == (3, 4, False)
    assert prep.count_contract(r, r).first().ok


def test_unicode_trim(spark):
    df = spark.createDataFrame([("　\t x y  \n",)], "t string")
    assert df.select(prep.trim_title(F.col("t")).alias("t")).first().t == "x y"


def test_hot_parent_key_with_skew_join(spark):
    """One question holds most answers; with broadcasting off the join is a
    sort-merge join whose hot partition AQE splits.  Results stay whole."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        q = spark.createDataFrame([(i, f"title {i}", "<p>Question body</p>", 10) for i in range(50)], Q_SCHEMA)
        a = spark.createDataFrame([(10_000 + j, 0 if j < 4000 else j % 50, LONG, 9) for j in range(5000)],
                                  A_SCHEMA)
        out = prep.build_qa_pairs(q, a)
        assert out.count() == 5000
        assert out.filter(F.col("question_title") == "title 0").count() == 4000 + 20
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
