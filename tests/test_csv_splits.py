"""Multi-line CSV by splits against Spark's own one-task reader."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuskit.sources import csvsplits, files


def dump(path, name, records, end="\n", last=True):
    def field(x):
        return "" if x is None else '"' + x.replace('"', '""') + '"' if not x.isdigit() else x

    lines = [",".join(map(field, r)) for r in [("Id", "ParentId", "Body", "Score"), *records]]
    with open(f"{path}/{name}", "w", newline="") as f:
        f.write(end.join(lines) + (end if last else ""))


def some_records(n, seed):
    rng = random.Random(seed)
    parts = ["<p>a,b\n", '"quoted"', "\n\n", "é€😀", " , ", "plain words here ", '""', "\\", "x" * 300]
    return [(str(i), str(i // 2), "".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 9, 40]))), str(rng.randrange(99)) if rng.random() < 0.9 else None) for i in range(n)]


SCHEMA = "Id long, ParentId long, Body string, Score int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def same(spark, path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    want = rows(files.read_qa_csv(spark, path, schema))
    df = files.read_qa_csv_splits(spark, path, schema)
    assert rows(df) == want
    return want


def test_one_file_in_many_tasks(spark, small_splits):
    d = tempfile.mkdtemp(prefix="csvs-")
    dump(d, "a.csv", some_records(400, 1))
    assert len(same(spark, d)) == 400
    lines = csvsplits._lines(spark, d)
    assert lines.rdd.getNumPartitions() > 20
    told = csvsplits.split_quotes(lines).collect()
    assert sum(r["inside"] for r in told) > 3 and len(told) > 20


def test_a_record_over_several_splits(spark, small_splits):
    d = tempfile.mkdtemp(prefix="csvs-")
    long = "\n".join(f'line {i} "of" a long body' for i in range(500))
    dump(d, "a.csv", [("1", "2", "short", "3"), ("4", "5", long, "6"), ("7", "8", "after\nit", "9"), ("10", "11", long[:9000], "12")], last=False)
    got = same(spark, d)
    assert [r for r in got if r[0] == 4][0][2] == long


def test_several_files_and_line_ends(spark, small_splits):
    d = tempfile.mkdtemp(prefix="csvs-")
    for i in range(5):
        dump(d, f"part-{i}.csv", some_records(30 * i, i), last=i % 2 == 0)
    open(f"{d}/part-9.csv", "w").close()
    assert len(same(spark, d)) == 300
    c = tempfile.mkdtemp(prefix="csvs-")
    dump(c, "crlf.csv", [(str(i), "2", f"one line {i}, {'x' * (i % 80)}", "3") for i in range(300)], end="\r\n")
    assert len(same(spark, c)) == 300


def test_header_only_and_bad_bytes(spark):
    d = tempfile.mkdtemp(prefix="csvs-")
    dump(d, "a.csv", [])
    assert same(spark, d) == []
    with open(f"{d}/b.csv", "wb") as f:
        f.write(b'Id,ParentId,Body,Score\n1,2,"ab\xffc\n",9\nNA,x,"",\n')
    assert (1, 2, "ab�c\n", 9) in [tuple(r) for r in files.read_qa_csv_splits(spark, d, files.T.StructType.fromDDL(SCHEMA)).collect()]


def test_no_text_is_shuffled(spark):
    d = tempfile.mkdtemp(prefix="csvs-")
    dump(d, "a.csv", some_records(50, 3))
    df = files.read_qa_csv_splits(spark, d, files.T.StructType.fromDDL(SCHEMA)).where(F.col("Score") > 50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    whole = plan.split("Union")[1].split("Window")[0]  # the branch of whole records
    assert "Exchange" not in whole.split("MapInArrow")[0]
