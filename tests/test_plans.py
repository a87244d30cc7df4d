"""Plans: the tier of each shape of program, SQL's answers, and the evaluator's on the same lines."""

import math

import duckdb
import pytest

import patternmill as P
from patternmill import queries as Q
from patternmill.sources.records import Records

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def normal(rows):
    out = []
    for row in rows:
        out.append(tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql_says_the_same(name, spark, sf_dir, duck):
    df = Q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    sql = duck.sql(Q.ORACLE_SQL[name])
    assert columns == sorted(sql.columns)
    assert normal(df.select(*columns).collect()) == normal(sql.select(*[f'"{c}"' for c in columns]).fetchall())


LINES = ["a 1 x", "b 2 y", "a 3 z", "", "c x 10x", "b  7 y", "a -2 é", "start 1", "b 1", "stop 2", "start 0", "stop 1 start"]

SHAPES = [
    ("A", "{ print $2, NF }"),
    ("A", "$2 > 1"),
    ("A", '$1 ~ /^[ab]$/ { $2 = $2 * 2; print } $1 == "c" { print "c", length($3) }'),
    ("A", '{ n = gsub(/[xyz]/, "<&>"); print n, $0 }'),
    ("A", '{ sub(/a/, "bb"); print $1; print toupper($0) }'),
    ("A", "{ print substr($0, 2, 3), index($0, \" \") }"),
    ("A", "NF == 0 { next } { print $NF }"),
    ("A", '{ x = $2 + 0; if (x > 2) y = "big"; else y = "small"; print y, x }'),
    ("A", "function f(a, b) { if (a > b) return a; return b } { print f($2 + 0, 2) }"),
    ("B", "{ s += $2; n[$1]++ } END { print s, NR; for (k in n) print k, n[k] }"),
    ("B", "{ for (i = 1; i <= NF; i++) w[$i]++ } END { for (k in w) print k, w[k] }"),
    ("B", "{ t = t $1 } END { print t }"),
    ("B", "$2 + 0 > m { m = $2 + 0; k = $1 } END { print k, m }"),
    ("D", "$2 > m { m = $2; k = $1 } END { print k, m }"),
    ("B", "{ last[$1] = $2 } END { for (k in last) print k, last[k] }"),
    ("B", "END { print $0, NF }"),
    ("C", "!seen[$1]++"),
    ("C", "{ print $2 - p; p = $2 }"),
    ("C", "{ s += $2; print s }"),
    ("C", "{ a[$1] += $2; print $1, a[$1] }"),
    ("C", "/start/, /stop/"),
    ("C", "NR % 3 == 0 { print NR, $1 }"),
    ("C", "NR > 4 { exit } { print }"),
    ("C", '$1 != last { print $1 } { last = $1 }'),
    ("C", "!($1 in a) { print \"new\", $1 } { a[$1]++ }"),
    ("C", "$1 == \"b\" && n++ < 2 { print $0 }"),
    ("D", "{ while (x < $2 + 0) x++; print x }"),
    ("D", "{ getline y; print $1, y }"),
    ("D", "function f(n) { return n < 2 ? 1 : n * f(n - 1) } { print f($2 % 5) }"),
    ("D", "{ a[NR] = $1 } END { for (i = NR; i > 0; i--) print a[i] }"),
]


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("tier,program", SHAPES, ids=[p[:40] for _, p in SHAPES])
def test_same_as_evaluator(tier, program, parts, spark):
    """The plan's lines are the evaluator's, however the records are dealt out."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LINES)], "i int, value string").repartitionByRange(parts, "i").sortWithinPartitions("i").select("value")
    plan = P.compile(program).plan(Records(df, None, Records.from_lines(spark, ["x"]).order))
    assert plan.tier == tier, plan.reason
    got = [r[0] for r in plan.df.collect()]
    assert sorted(got) == sorted(P.run(program, "\n".join(LINES) + "\n").split("\n")[:-1])


def test_text_files(spark, tmp_path):
    """Operands keep their order; numbers run on over files; paragraphs are records."""
    for i, n in enumerate((3, 4000, 5)):
        (tmp_path / f"f{i}").write_text("".join(f"{i} {j}\r\n" for j in range(n)))
    paths = [str(tmp_path / f"f{i}") for i in (2, 0, 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = P.compile("NR == 1 || NR == 6 || NR == 9 { print NR, $0 }").to_df(P.read(spark, paths)).collect()
        assert sorted(r[0] for r in got) == ["1 2 0", "6 0 0", "9 1 0"]
        total = P.compile("{ s += $2; if ($2 == 3999) print s }").to_df(P.read(spark, paths)).collect()
        assert [r[0] for r in total] == [str(10 + 3 + 3999 * 2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "p").write_text("\n\na\nb\n\n\nc\n")
    got = P.compile("{ print NF, $1 }").to_df(P.read(spark, str(tmp_path / "p"), P.Config(rs=""))).collect()
    assert sorted(r[0] for r in got) == ["1 c", "2 a"]


def test_paragraphs_over_blocks(spark, tmp_path):
    """Paragraphs are the evaluator's wherever blocks cut a file, and none runs on into the next file."""
    texts = ["a b\nc\n\n\n\nd", "\n\n\ne f\n\ng\nh\ni\n\n\n", "", "\n", "j"]
    for i, t in enumerate(texts):
        (tmp_path / f"t{i}").write_text(t)
    want = [p for t in texts for p in P.run('BEGIN { RS = "" } { gsub(/\\n/, "/"); print NF, $0 }', t).split("\n")[:-1]]
    program = P.compile('{ gsub(/\\n/, "/"); print NF, $0 }')
    for size in ("3", "5", "100"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            own = P.read(spark, [str(tmp_path / f"t{i}") for i in range(len(texts))], P.Config(rs=""))
            assert sorted(r[0] for r in program.to_df(own).collect()) == sorted(want)
            first = P.compile("NR == 2 { print $1 }").to_df(own).collect()
            assert [r[0] for r in first] == ["d"]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_filters_reach_the_scan(spark, sf_dir):
    """Predicates and columns are pushed to Parquet."""
    df = Q.QUERIES["filter_num"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "l_comment" not in plan and "l_tax" not in plan
    grouped = Q.QUERIES["group_multikey"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in grouped and "partial_sum" in grouped


def test_sinks(spark, tmp_path, sf_dir):
    from patternmill.sources import write_by_destination, write_text

    write_by_destination(Q.QUERIES["destinations"](spark, sf_dir), str(tmp_path / "d"))
    assert len(list((tmp_path / "d").glob("dest=*"))) == 5
    write_text(P.compile("{ print $2 }").to_df(Q.records(spark, sf_dir, "region")), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 5


def test_lookup_too_odd_for_a_join(spark):
    """A program that must run record by record still sees its lookup table."""
    table = spark.createDataFrame([("a", "one"), ("b", "two")], "k string, v string")
    program = 'BEGIN { while ((getline l < "t") > 0) { split(l, p); t[p[1]] = p[2] } } { while (n < 1) n++; if ($1 in t) print t[$1] }'
    plan = P.compile(program).plan(P.Records.from_lines(spark, ["a", "c", "b"]), P.Config(tables={"t": table}))
    assert plan.tier == "D" and sorted(r[0] for r in plan.df.collect()) == ["one", "two"]


def test_sort_command(spark):
    own = P.Records.from_lines(spark, ["b 10", "a 9", "c 100"])
    assert [r[0] for r in P.compile('{ print | "sort" }').to_df(own).collect()] == ["a 9", "b 10", "c 100"]
    assert [r[0] for r in P.compile('{ print $0 | "sort -k2 -rn" }').to_df(own).collect()] == ["c 100", "b 10", "a 9"]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "value string")
    own = Records(empty, None, Records.from_lines(spark, ["x"]).order)
    assert P.compile("{ n++ } END { print NR, n + 0 }").to_df(own).collect()[0][0] == "0 0"
    assert P.compile("{ print }").to_df(own).collect() == []


BATCHED = [
    '{ n = 0; x = $2 + 0; while (x > 1 && n < 50) { x = x % 2 ? 3 * x + 1 : x / 2; n++ } print $1, n }',
    '{ s = 0; i = 1; do { if (i == 3) { i++; continue } s += i; if (s > 20) break; i++ } while (i < $2 + 4); print s, i }',
    '{ x = 0 } $2 + 0 > 2 { for (i = 0; i < $2; i += 2) x += i * i; print "big", x } { while (x > 5) x -= 5; print $1 "-" x, NF; if (x == 4) next; print "end" }',
    '{ k = 0; while (k * k < ($2 ^ 2) / 2) { if ($1 == "b") { print "b at", k; k++ } ++k } printf "%s|%5.1f|%d\\n", $1, k / 3, -k }',
    '{ t = 7; while (t > 1) { t = int(t / 2); if (!(t % 3) || t == 1 && $1 ~ /^[ac]/) print t, sqrt(t) } }',
]


@pytest.mark.parametrize("program", BATCHED)
def test_whole_batches(program, spark):
    """What numpy does on whole batches is what the evaluator does record by record, in its order."""
    df = spark.createDataFrame([(s,) for s in LINES], "value string").coalesce(1)
    plan = P.compile(program).plan(Records(df, None, Records.from_lines(spark, ["x"]).order))
    assert plan.tier == "D" and "whole batches" in plan.reason, plan.reason
    assert [r[0] for r in plan.df.collect()] == P.run(program, "\n".join(LINES) + "\n").split("\n")[:-1]


def test_what_lasts():
    """A variable lasts where some path reads it before the record has set it."""
    from patternmill.plans.flow import lasting
    from patternmill.plans.syntax import parse

    for program, want in [
        ("{ print x; while (x < 3) x++; x = $1 }", {"x"}),
        ("{ x = 0; while (x < $1) x++; print x }", set()),
        ("$1 { x = 1 } { print x }", {"x"}),
        ("{ if ($1) x = 1; else x = 2; print x }", set()),
        ("{ if ($1) x = 1; else next; print x }", set()),
        ("{ $1 && (x = 1); print x }", {"x"}),
        ("{ n = split($0, a); for (i = 1; i <= n; i++) print a[i] }", set()),
        ("{ a[$1] = 1; print length(a) }", {"a"}),
        ("function f(y) { z += y; return z } { print f($1) }", {"z"}),
        ("{ OFS = $1; print 1, 2 }", {"OFS"}),
        ("{ do { if ($1) continue; x = 1 } while (x) }", {"x"}),
    ]:
        assert lasting(parse(program)) == want, program


def test_nulls_in_batches(spark):
    """A null number prints as nothing and counts as 0."""
    df = spark.createDataFrame([(1, None, "a"), (None, 2.5, None)], "i long, x double, s string").coalesce(1)
    plan = P.compile("{ n = 0; while (n < $1 + $2) n++; print $1, $2, $3, n }").plan(df, columns=["i", "x", "s", "n"])
    assert "whole batches" in plan.reason and [tuple(r) for r in plan.df.collect()] == [("1", "", "a", "1"), ("", "2.5", "", "3")]
