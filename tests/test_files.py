import json
import os
import tempfile

from corpuskit.sources import files


def test_csv_round_trip_with_quotes_newlines(spark):
    rows = [(1, None, None, None, 7, '  say "hi"\n', '<p>a,b\n"c"</p>\\'), (2, None, None, None, None, "", None)]
    df = spark.createDataFrame(rows, files.QUESTIONS_SCHEMA)
    path = tempfile.mkdtemp(prefix="csv-")
    files.write_qa_csv(df, path + "/q")
    back = sorted(files.read_qa_csv(spark, path + "/q", files.QUESTIONS_SCHEMA).collect(), key=lambda r: r.Id)
    assert back[0].Title == '  say "hi"\n' and back[0].Body == '<p>a,b\n"c"</p>\\' and back[0].Score == 7
    assert back[1].Score is None


def test_csv_bad_byte_decodes_to_replacement(spark):
    d = tempfile.mkdtemp(prefix="csvb-")
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write(b'Id,ParentId,Body,Score\n1,2,"ab\xffc",9\n')
    schema = "Id long, ParentId long, Body string, Score int"
    r = spark.read.options(**files.CSV_OPTIONS).schema(schema).csv(d).first()
    assert r.Body == "ab�c"


def test_prediction_shapes(spark):
    d = tempfile.mkdtemp(prefix="pred-")
    texts = ["x", "y z", "w"]
    with open(f"{d}/obj.json", "w") as f:
        json.dump({"responses": texts}, f, indent=2)
    with open(f"{d}/pred.json", "w") as f:
        json.dump({"predictions": texts}, f)
    with open(f"{d}/arr.json", "w") as f:
        json.dump(texts, f)
    with open(f"{d}/lines.jsonl", "w") as f:
        f.write("\n".join(json.dumps({"text": t}) for t in texts) + "\n")
    for path, shape in [("obj.json", "responses"), ("pred.json", "predictions"), ("arr.json", "array"),
                        ("lines.jsonl", "jsonl")]:
        got = sorted((r.idx, r.text) for r in files.read_predictions(spark, f"{d}/{path}", shape).collect())
        assert got == list(enumerate(texts)), shape


def test_line_index_follows_file_order(spark):
    d = tempfile.mkdtemp(prefix="lines-")
    # files of very different sizes (the reader packs splits by size) and one
    # file split into several blocks
    n = 0
    for i, count in enumerate([5, 3000, 40, 200000, 1]):
        with open(f"{d}/part-{i:02d}.jsonl", "w") as f:
            for _ in range(count):
                f.write(json.dumps({"text": str(n)}) + "\n")
                n += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = files.read_predictions(spark, d, "jsonl").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n
    assert all(int(r.text) == r.idx for r in got)


def test_first_samples_by_line_without_idx(spark):
    d = tempfile.mkdtemp(prefix="smp-")
    for name, lines in (("part-99999.jsonl", [0, 1]), ("part-100000.jsonl", [2, 3]), ("part-100001.jsonl", [4])):
        with open(f"{d}/{name}", "w") as f:
            f.write("".join(json.dumps({"prompt": f"p{i}", "answer": "x"}) + "\n" for i in lines))
    assert sorted(r.prompt for r in files.read_samples(spark, d, num_samples=3).collect()) == ["p0", "p1", "p2"]
    assert files.read_samples(spark, d).count() == 5


def test_csv_to_parquet_and_samples_head(spark):
    d = tempfile.mkdtemp(prefix="conv-")
    q = spark.createDataFrame([(i, None, None, None, i, f"t{i}", f"<p>b\n{i}</p>") for i in range(20)],
                              files.QUESTIONS_SCHEMA)
    files.write_qa_csv(q, f"{d}/csv")
    pq = files.csv_to_parquet(spark, f"{d}/csv", f"{d}/pq", files.QUESTIONS_SCHEMA)
    assert pq.count() == 20 and pq.filter("Body = '<p>b\\n7</p>'").count() == 1
    s = spark.createDataFrame([(i, f"p{i}", f"a{i}") for i in range(30)], "idx long, prompt string, answer string")
    files.write_jsonl(s, f"{d}/jsonl")
    head = files.read_samples(spark, f"{d}/jsonl", num_samples=5).collect()
    assert [r.idx for r in head] == [0, 1, 2, 3, 4]
