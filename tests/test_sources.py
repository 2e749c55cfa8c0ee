import pytest
from pyspark.errors import PySparkException

from quillon.operators import relational as R
from quillon.plans import pig, statements
from quillon.sources import files


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


def test_delimited_rows_of_any_length(spark, tmp_path):
    path = _write(tmp_path, "t.txt", "1|a|2.5|extra|more\n2|b\nx||7\n\n")
    rows = [tuple(r) for r in files.read_delimited(spark, path, "i int, s string, d double").collect()]
    assert rows == [(1, "a", 2.5), (2, "b", None), (None, "", 7.0), (None, None, None)]


def test_last_column_takes_the_rest(spark, tmp_path):
    path = _write(tmp_path, "t.txt", "1|a|b|c\n2|x\n")
    assert [tuple(r) for r in files.read_delimited(spark, path, "i int, s string", last_takes_rest=True).collect()] == [(1, "a|b|c"), (2, "x")]


def test_adjacency_lines(spark, tmp_path):
    path = _write(tmp_path, "g.txt", "0 1 50\n1 1 2 2\n25\n")
    v, e = files.read_adjacency(spark, path)
    assert sorted(r.id for r in v.collect()) == [0, 1, 25]
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (0, 50), (1, 1), (1, 2)]
    assert files.read_adjacency(spark, path, distinct=False)[1].count() == 5


def test_fastq_pairs(spark, tmp_path):
    one = _write(tmp_path, "1.fastq", "".join(f"@r{i}\nACG{b}\n+\nIIII\n" for i, b in enumerate("ACG")))
    two = _write(tmp_path, "2.fastq", "".join(f"@r{i}\nTTT{b}\n+\nIIII\n" for i, b in enumerate("ACG")))
    rows = sorted(tuple(r) for r in files.read_fastq(spark, one, two).collect())
    assert rows == [(1, "ACGA", "TTTA"), (2, "ACGC", "TTTC"), (3, "ACGG", "TTTG")]
    short = _write(tmp_path, "3.fastq", "@r\nAAAA\n+\nIIII\n")
    with pytest.raises(PySparkException, match="differ in length"):
        files.read_fastq(spark, one, short).collect()


def test_fastq_over_many_partitions(spark, tmp_path):
    path = _write(tmp_path, "big.fastq", "".join(f"@r{i}\n{'ACGT'[i % 4] * 20}\n+\n{'I' * 20}\n" for i in range(5000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = sorted(tuple(r)[:2] for r in files.read_fastq(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert rows == [(i + 1, "ACGT"[i % 4] * 20) for i in range(5000)]


def test_word_count(spark):
    lines = spark.createDataFrame([("a b  a",), (None,), ("",), ("b\ta",)], "value string")
    assert {r.word: r.n for r in files.word_count(lines).collect()} == {"a": 3, "b": 2}


def test_graphviz(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (3, 4, "z")], "src long, dst long, label string")
    lines = [r.value for r in files.graphviz(e, [1], 2).collect()]
    assert lines == ["digraph G {", '  "1" -> "2" [label="x"];', '  "2" -> "3" [label="y"];', "}"]


def test_pig(spark, tmp_path):
    src = _write(tmp_path, "p.csv", "5,five\n6,six\n10,ten\n")
    out = f"file://{tmp_path}/out"
    got = pig.run(spark, f'R = load "nc1:{src}" as (id : int, name : chararray); S = filter R by (id - 1) * 2 >= 8 and name != "ten" or id == 10 and id % 3 == 2; dump S into "nc1:{out}";')
    assert sorted(r.id for r in got["S"].collect()) == [5, 6]
    assert spark.read.text(out).count() == 2
    for bad in ('R = laod "x" as (id : int);', 'R = load "x" as (id : number);', 'dump R', "R = load 'x' as (a : int);"):
        with pytest.raises((SyntaxError, KeyError)):
            pig.run(spark, bad)


def test_pig_types(spark):
    p = pig._Parser("(a : long, b : bag {tuple (x : int, y : double)}, m : map [])")
    assert p.fields(" ") == "a bigint,b array<struct<x:int,y:double>>,m map<string,string>"


def test_statements(spark, tmp_path):
    src = _write(tmp_path, "t.txt", "1|a\n2|b\n3|a\n")
    run = statements.Runner(spark)
    run.script(f"""
-- a comment
SET low=2; DROP TABLE IF EXISTS t;
CREATE EXTERNAL TABLE t (k INT, s STRING) ROW FORMAT DELIMITED FIELDS TERMINATED BY '|' STORED AS TEXTFILE LOCATION '{src}';
CREATE TABLE o (s STRING, n INT);
INSERT OVERWRITE TABLE o SELECT s, COUNT(*) FROM t WHERE k >= ${{hiveconf:low}} GROUP BY s;""")
    assert sorted(tuple(r) for r in run.table("o").collect()) == [("a", 1), ("b", 1)]
    assert "Physical Plan" in run.run("EXPLAIN SELECT * FROM t").first().plan
    assert run.script("SELECT MAX(k) AS m FROM t").first().m == 3
    with pytest.raises(ValueError):
        run.run("INSERT OVERWRITE TABLE o SELECT s FROM t")


def test_theta_join_beyond_the_broadcast_bound(spark, monkeypatch):
    a, b = spark.range(20).toDF("a"), spark.range(10).toDF("b")
    want = sorted((x, y) for x in range(20) for y in range(10) if x < y)
    from pyspark.sql import functions as F

    assert sorted(map(tuple, R.theta_join(a, b, F.col("a") < F.col("b")).collect())) == want
    monkeypatch.setattr(R, "BROADCAST_ROWS", 5)
    assert sorted(map(tuple, R.theta_join(a, b, F.col("a") < F.col("b")).collect())) == want


def test_top_k_and_set_operations(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, s string")
    assert [tuple(r) for r in R.top_k(df, 2, F.asc("k"), F.asc("s")).collect()] == [(1, "a"), (1, "b")]
    assert R.union_all(df, df, df).count() == 9
    assert R.distinct(R.union_all(df, df)).count() == 3
    assert R.id_union(df, df, "k").count() == 2
