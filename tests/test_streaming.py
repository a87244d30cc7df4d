import pytest

import patternmill as P
from patternmill.streaming import keyed_state, stream_program


def _run(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def _source(spark, tmp_path):
    rows = [("a", 1.0), ("b", 2.0), ("a", 3.0)]
    spark.createDataFrame(rows, "k string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in"))


def test_stateless(spark, tmp_path):
    df, mode = stream_program("$2 > 1 { print $1, $2 * 2 }", _source(spark, tmp_path), ["k", "x"])
    assert mode == "append" and _run(spark, df, mode, "s1") == [("a", 6.0), ("b", 4.0)]


def test_aggregate(spark, tmp_path):
    df, mode = stream_program("{ s[$1] += $2 } END { for (k in s) print k, s[k] }", _source(spark, tmp_path), ["k", "s"])
    assert mode == "complete" and _run(spark, df, mode, "s2") == [("a", 4.0), ("b", 2.0)]


def test_keyed_state(spark, tmp_path):
    df = keyed_state("{ s[$1] += $2; print $1, s[$1] }", _source(spark, tmp_path), ["k", "s"], key=1)
    assert _run(spark, df, "update", "s3") == [("a", "1"), ("a", "4"), ("b", "2")]


def test_state_over_triggers(spark, tmp_path):
    """State lasts from trigger to trigger, with the kinds of its values; what no key keeps is refused."""
    for i, rows in enumerate([[("a", "1"), ("b", "x")], [("a", "10"), ("b", "2")]]):
        spark.createDataFrame(rows, "k string, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, v string").parquet(str(tmp_path / "in"))
        df = keyed_state("{ n[$1]++; if ($1 in last && last[$1] < $2) print $1, n[$1], last[$1]; last[$1] = $2 }", stream, ["k", "n", "last"], key=1)
        q = df.writeStream.foreachBatch(lambda b, _, i=i: b.write.mode("overwrite").parquet(str(tmp_path / f"out{i}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out1")).collect())
    assert got == [("a", "2", "1")]  # 1 < 10 as numbers, "x" > "2" as text
    for program in ("{ n++; print $1, n }", "{ print NR, $1 }", "/a/, /b/"):
        with pytest.raises(P.CompileError):
            keyed_state(program, stream, ["k", "n"], key=1)
