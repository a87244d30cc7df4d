"""The language's operators as queries over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Config, Program
from .sources.records import Records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
}


def records(spark: SparkSession, sf_dir: str, table: str) -> Records:
    """$1, $2, ... are the table's columns in order."""
    return Records.from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), _COLUMNS[table].split())


def _add(name: str, table: str, program: str, columns: str, sql: str, after: Callable[[DataFrame], DataFrame] | None = None, lookups: str = "", **config) -> None:
    """A program over a table, its columns' names, and the same as SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: records(spark, sf_dir, t) for t in lookups.split()}
        df = Program(program).to_df(records(spark, sf_dir, table), columns.split(), Config(tables=tables, **config))
        return after(df) if after else df

    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _rounded(*names: str, digits: int = 2) -> Callable[[DataFrame], DataFrame]:
    """Sums depend on the order of addition in their last digits, so both sides round."""
    return lambda df: df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- filters and projections

_add("filter_num", "lineitem", "$5 > 30 { print $1, $4, $5 }", "l_orderkey l_linenumber l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30")
_add("filter_str", "lineitem", '$9 == "R" { print $1, $5 }', "l_orderkey l_quantity", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
_add("filter_regex", "part", "$2 ~ /[13579]$/ { print $1, $2 }", "p_partkey p_name", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[13579]$')")
_add("filter_not_regex", "part", "$4 !~ /^(STANDARD|ECONOMY)/ { print $1, $4 }", "p_partkey p_type", "SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(p_type, '^(STANDARD|ECONOMY)')")
_add("filter_logic", "lineitem", '($5 < 10 || $5 > 40) && !($10 == "O") { print $1, $4 }', "l_orderkey l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 10 OR l_quantity > 40) AND l_linestatus <> 'O'")
_add("filter_date", "orders", '$5 < "1996-01-01" { print $1, $5 }', "o_orderkey o_orderdate", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') < '1996-01-01'")
_add("record_regex", "nation", "/_1/", "n_nationkey n_name n_regionkey", "SELECT * FROM nation WHERE contains(n_nationkey || ' ' || n_name || ' ' || n_regionkey, '_1')")
_add("project_arith", "lineitem", "{ print $1, $4, $6 * (1 - $7) * (1 + $8) }", "l_orderkey l_linenumber charge", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
_add("project_power_mod", "orders", "{ print $1, ($1 % 7) ^ 2, ($1 + 3) % 5, int($4 / 1000) }", "o_orderkey sq rest thousands", "SELECT o_orderkey, (o_orderkey % 7)::DOUBLE ^ 2 AS sq, ((o_orderkey + 3) % 5)::DOUBLE AS rest, trunc(o_totalprice / 1000) AS thousands FROM orders")
_add("project_concat", "customer", '{ print $1 ":" $5, length($2) }', "tag n", "SELECT c_custkey || ':' || c_mktsegment AS tag, strlen(c_name)::DOUBLE AS n FROM customer")
_add("field_count_last", "nation", "{ print NF, $NF, $(NF-1) }", "nf last before", "SELECT 3 AS nf, n_regionkey AS last, n_name AS before FROM nation")
_add("ternary_bucket", "customer", '{ print $1, ($4 > 5000 ? "high" : $4 > 0 ? "mid" : "debt") }', "c_custkey bucket", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'debt' END AS bucket FROM customer")
_add("multi_rule_next", "orders", '$3 == "O" { print $1, "open"; next } $4 > 200000 { print $1, "large" } { print $1, "any" }', "o_orderkey what",
     "SELECT o_orderkey, 'open' AS what FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'any' FROM orders WHERE o_orderstatus <> 'O'")
_add("if_else_local", "lineitem", '{ x = $6; if ($9 == "R") x = -x; else if ($10 == "O") x = x / 2; print $1, $4, x }', "l_orderkey l_linenumber x", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice WHEN l_linestatus = 'O' THEN l_extendedprice / 2 ELSE l_extendedprice END AS x FROM lineitem")
_add("assign_field", "customer", '{ $4 = $4 * 2; $5 = tolower($5); print $1, $4, $5 }', "c_custkey doubled segment", "SELECT c_custkey, c_acctbal * 2 AS doubled, lower(c_mktsegment) AS segment FROM customer")
_add("constant_loop", "customer", "{ s = 0; for (i = 1; i <= 4; i++) s = s + i * $3; print $1, s }", "c_custkey s", "SELECT c_custkey, (10 * c_nationkey)::DOUBLE AS s FROM customer")
_add("begin_variables", "orders", 'BEGIN { limit = 150000; tag = "big" } $4 > limit { print tag, $1 }', "tag o_orderkey", "SELECT 'big' AS tag, o_orderkey FROM orders WHERE o_totalprice > 150000")
_add("given_variable", "lineitem", '$9 == flag { n++ } END { print flag, n }', "flag n", "SELECT 'A' AS flag, count(*)::DOUBLE AS n FROM lineitem WHERE l_returnflag = 'A'", variables={"flag": "A"})

# ---- string and number functions

_add("string_functions", "part", '{ print $1, toupper($2), substr($4, 2, 5), index($4, " "), substr($3, 3) }', "p_partkey up piece blank tail", "SELECT p_partkey, upper(p_name) AS up, substr(p_type, 2, 5) AS piece, instr(p_type, ' ')::DOUBLE AS blank, substr(p_brand, 3) AS tail FROM part")
_add("byte_length", "documents", "{ print $1, length($2), (index($2, \"e\") > 0) }", "doc_id bytes has_e", "SELECT doc_id, strlen(text)::DOUBLE AS bytes, contains(text, 'e')::INT::DOUBLE AS has_e FROM documents")
_add("gsub_count", "documents", '{ n = gsub(/[aeiou]+/, "<&>", $2); print $1, n, length($2) }', "doc_id n bytes",
     "SELECT doc_id, len(regexp_extract_all(text, '[aeiou]+'))::DOUBLE AS n, strlen(regexp_replace(text, '([aeiou]+)', '<\\1>', 'g'))::DOUBLE AS bytes FROM documents")
_add("sub_first", "part", '{ sub(/[A-Z]+/, "(&)", $4); print $1, $4 }', "p_partkey p_type", "SELECT p_partkey, regexp_replace(p_type, '([A-Z]+)', '(\\1)') AS p_type FROM part")
_add("match_position", "part", "{ at = match($4, /[AEIOU][A-Z]/); print $1, at, RSTART, RLENGTH }", "p_partkey at rstart rlength",
     "SELECT p_partkey, coalesce(instr(p_type, nullif(regexp_extract(p_type, '[AEIOU][A-Z]'), '')), 0)::DOUBLE AS at, coalesce(instr(p_type, nullif(regexp_extract(p_type, '[AEIOU][A-Z]'), '')), 0)::DOUBLE AS rstart, (CASE WHEN regexp_matches(p_type, '[AEIOU][A-Z]') THEN 2 ELSE -1 END)::DOUBLE AS rlength FROM part")
_add("split_pieces", "orders", '{ n = split($5, p, /[- :]/); print $1, n, p[1], p[2] + 0 }', "o_orderkey n year month", "SELECT o_orderkey, 6 AS n, strftime(o_orderdate, '%Y') AS year, month(o_orderdate)::DOUBLE AS month FROM orders")
_add("sprintf_simple", "customer", '{ print sprintf("%06d|%-12s|%s", $1, $5, $3) }', "line", "SELECT lpad(c_custkey::VARCHAR, 6, '0') || '|' || rpad(c_mktsegment, greatest(12, length(c_mktsegment))::INT, ' ') || '|' || c_nationkey AS line FROM customer")
_add("sprintf_c_rounding", "supplier", '{ print $1, sprintf("%.1f", $4) }', "s_suppkey bal", "SELECT s_suppkey, printf('%.1f', s_acctbal) AS bal FROM supplier")
_add("math_functions", "customer", "$4 > 0 { print $1, sqrt($4), exp($4 / 10000), log($4), sin($4), cos($4), atan2($4, 1000), int(-$4) }", "c_custkey root e l s c a i",
     "SELECT c_custkey, round(sqrt(c_acctbal), 6) AS root, round(exp(c_acctbal / 10000), 6) AS e, round(ln(c_acctbal), 6) AS l, round(sin(c_acctbal), 6) AS s, round(cos(c_acctbal), 6) AS c, round(atan2(c_acctbal, 1000), 6) AS a, trunc(-c_acctbal) AS i FROM customer WHERE c_acctbal > 0",
     _rounded("root", "e", "l", "s", "c", "a", digits=6))
_add("count_words", "documents", "{ print $1, split($2, w) }", "doc_id n", "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> ''))::INT AS n FROM documents")

# ---- aggregation

_add("group_sum", "lineitem", "{ s[$9] += $5 } END { for (k in s) print k, s[k] }", "l_returnflag sum_qty", "SELECT l_returnflag, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY 1")
_add("group_count", "events", "{ n[$4]++ } END { for (k in n) print k, n[k] }", "event_type n", "SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1")
_add("group_multikey", "lineitem", "{ q[$9 SUBSEP $10] += $5; n[$9 SUBSEP $10]++ } END { for (k in q) { split(k, p, SUBSEP); print p[1], p[2], q[k], n[k], q[k] / n[k] } }",
     "l_returnflag l_linestatus sum_qty n avg_qty", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*)::DOUBLE AS n, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY 1, 2", _rounded("avg_qty", digits=6))
_add("group_comma_key", "orders", "{ n[$3, $6]++ } END { for (k in n) { split(k, p, SUBSEP); print p[1], p[2], n[k] } }", "status priority n", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2")
_add("group_extremes", "orders", "{ if (!($2 in hi) || $4 > hi[$2]) hi[$2] = $4; if (!($2 in lo) || $4 < lo[$2]) lo[$2] = $4 } END { for (k in hi) print k, hi[k], lo[k] }",
     "o_custkey hi lo", "SELECT o_custkey, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY 1")
_add("group_last", "events", "{ last[$3] = $4; n[$3]++ } END { for (k in last) print k, last[k], n[k] }", "user_id last n", "SELECT user_id, arg_max(event_type, event_id) AS last, count(*)::DOUBLE AS n FROM events GROUP BY 1")
_add("group_filtered", "lineitem", '$7 > 0.05 { s[$10] += $6 * $7 } END { for (k in s) print k, s[k] }', "l_linestatus saved", "SELECT l_linestatus, round(sum(l_extendedprice * l_discount), 2) AS saved FROM lineitem WHERE l_discount > 0.05 GROUP BY 1", _rounded("saved"))
_add("global_agg", "orders", "{ n++; t += $4 } END { print n, t, t / n, NR }", "n total mean nr", "SELECT count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS nr FROM orders", lambda df: _rounded("mean", digits=4)(_rounded("total")(df)))
_add("arg_max", "orders", "$4 > m { m = $4; k = $1 } END { print k, m }", "o_orderkey m", "SELECT arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS m FROM orders")
_add("min_seeded", "customer", "NR == 1 || $4 < m { m = $4 } END { print m }", "m", "SELECT min(c_acctbal) AS m FROM customer")
_add("top_group", "orders", "{ s[$2] += $4 } END { for (k in s) if (s[k] > m) { m = s[k]; b = k } print b, m }", "o_custkey m", "SELECT o_custkey, round(s, 2) AS m FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ORDER BY s DESC, o_custkey LIMIT 1", _rounded("m"))
_add("having", "orders", "{ n[$2]++ } END { for (k in n) if (n[k] > 15) print k, n[k] }", "o_custkey n", "SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
_add("two_arrays", "lineitem", "{ a[$2]++; if ($9 == \"R\") b[$2]++ } END { for (k in a) if (k in b) print k, a[k], b[k] }", "l_partkey n returned",
     "SELECT l_partkey, count(*)::DOUBLE AS n, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS returned FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0")
_add("count_distinct", "events", "{ u[$3]++ } END { print length(u) }", "n", "SELECT count(DISTINCT user_id) AS n FROM events")
_add("histogram", "orders", "{ h[int($4 / 50000)]++ } END { for (b in h) print b, h[b] }", "bucket n", "SELECT floor(o_totalprice / 50000) AS bucket, count(*)::DOUBLE AS n FROM orders GROUP BY 1")
_add("product", "region", "{ p = p * ($1 + 1) } BEGIN { p = 1 } END { print p }", "p", "SELECT product(r_regionkey + 1) AS p FROM region")
_add("word_count", "documents", '{ n = split(tolower($2), w, /[^a-z]+/); for (i = 1; i <= n; i++) if (w[i] != "") c[w[i]]++ } END { for (k in c) print k, c[k] }', "word n",
     "SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
_add("distinct_first", "events", "!seen[$4]++ { print $1, $4 }", "event_id event_type", "SELECT min(event_id) AS event_id, event_type FROM events GROUP BY 2")
_add("append_string", "nation", '{ s = s $2 ";" } END { print length(s), substr(s, 1, 20) }', "n head", "SELECT strlen(string_agg(n_name || ';', '' ORDER BY n_nationkey))::DOUBLE AS n, substr(string_agg(n_name || ';', '' ORDER BY n_nationkey), 1, 20) AS head FROM nation")

# ---- order: numbers, ranges, and what is carried from record to record

_add("first_records", "orders", "NR <= 100 { print NR, $1 }", "nr o_orderkey", "SELECT nr::DOUBLE AS nr, o_orderkey FROM (SELECT row_number() OVER (ORDER BY file_row_number) AS nr, o_orderkey FROM (SELECT o_orderkey, row_number() OVER () AS file_row_number FROM orders)) WHERE nr <= 100")
_add("every_nth", "orders", "NR % 10 == 0 { print $1 }", "o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER () AS nr FROM orders) WHERE nr % 10 = 0")
_add("exit_early", "orders", "NR > 50 { exit } { print $1, $4 }", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER () AS nr FROM orders) WHERE nr <= 50")
_add("last_record", "orders", "END { print NR, $1 }", "nr o_orderkey", "SELECT count(*) AS nr, arg_max(o_orderkey, nr) AS o_orderkey FROM (SELECT o_orderkey, row_number() OVER () AS nr FROM orders)")
_add("running_sum", "events", "{ s[$3] += $5; print $1, s[$3] }", "event_id total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS total FROM events", _rounded("total"))
_add("running_count_global", "events", '$4 == "error" { n++ } { print $1, n + 0 }', "event_id errors", "SELECT event_id, (count(*) FILTER (event_type = 'error') OVER (ORDER BY event_id))::DOUBLE AS errors FROM events")
_add("lag_delta", "events", "{ print $1, $5 - prev[$3]; prev[$3] = $5 }", "event_id delta", "SELECT event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events")
_add("change_detection", "events", '$4 != last { print $1, $4 } { last = $4 }', "event_id event_type", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
_add("range_pattern", "events", '$4 == "error", $4 == "signup" { print $1, $4 }', "event_id event_type",
     """WITH RECURSIVE e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS i FROM events),
marks AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 0 END AS mark FROM e),
state AS (SELECT *, last_value(mark IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marks)
SELECT event_id, event_type FROM state WHERE before = 1 OR mark = 1""")  # fmt: skip

_add("sorted_output", "supplier", '{ print $1, $4 | "sort -k2 -n -r" }', "s_suppkey s_acctbal", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC")

# ---- lookups

_LOAD = 'BEGIN { while ((getline line < "nation") > 0) { split(line, p); name[p[1]] = p[2]; region[p[1]] = p[3] } } '
_add("lookup_join", "customer", _LOAD + "$3 in name { print $1, name[$3], region[$3] }", "c_custkey nation region", "SELECT c_custkey, n_name AS nation, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey", lookups="nation")
_ASIA = 'BEGIN { while ((getline line < "nation") > 0) { split(line, p); if (p[3] == 2) t[p[1]] = p[2] } } '
_add("lookup_semi", "supplier", _ASIA + "$3 in t { print $1, $2 }", "s_suppkey s_name", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", lookups="nation")
_add("lookup_anti", "supplier", _ASIA + "!($3 in t) { print $1, $2 }", "s_suppkey s_name", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", lookups="nation")
_add("lookup_outer", "supplier", _ASIA + '{ print $1, ($3 in t) ? t[$3] : "elsewhere" }', "s_suppkey nation", "SELECT s_suppkey, coalesce(n_name, 'elsewhere') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 2", lookups="nation")
_add("lookup_aggregate", "lineitem", 'BEGIN { while ((getline line < "orders") > 0) { split(line, p); status[p[1]] = p[3] } } $1 in status { s[status[$1]] += $5 } END { for (k in s) print k, s[k] }', "o_orderstatus sum_qty",
     "SELECT o_orderstatus, sum(l_quantity) AS sum_qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", lookups="orders")

# ---- functions, and programs that run record by record

_add("function_inline", "lineitem", "function net(p, d) { if (d > 0.05) return p * (1 - d); return p } { print $1, $4, net($6, $7) }", "l_orderkey l_linenumber net", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END AS net FROM lineitem")
_add("function_recursive", "nation", "function fac(n) { return n <= 1 ? 1 : n * fac(n - 1) } { print $1, fac($1 % 10) }", "n_nationkey f", "SELECT n_nationkey::VARCHAR AS n_nationkey, factorial((n_nationkey % 10)::INT)::VARCHAR AS f FROM nation")
_add("while_loop", "orders", "{ n = 0; x = $1; while (x > 1 && n < 1000) { x = x % 2 ? 3 * x + 1 : x / 2; n++ } print $1, n }", "o_orderkey steps",
     """WITH RECURSIVE c AS (SELECT o_orderkey, o_orderkey AS x, 0 AS n FROM orders UNION ALL SELECT o_orderkey, CASE WHEN x % 2 = 1 THEN 3 * x + 1 ELSE x // 2 END, n + 1 FROM c WHERE x > 1)
SELECT o_orderkey::VARCHAR AS o_orderkey, max(n)::VARCHAR AS steps FROM c GROUP BY 1""")  # fmt: skip
_add("getline_pairs", "nation", "{ a = $2; if ((getline) > 0) print a, $2 }", "a b", "SELECT max(n_name) FILTER (n_nationkey % 2 = 0) AS a, max(n_name) FILTER (n_nationkey % 2 = 1) AS b FROM nation GROUP BY n_nationkey // 2 HAVING count(*) = 2")
_add("destinations", "nation", '{ print $2 > ("region" $3) }', "unused", "SELECT 'region' || n_regionkey AS dest, n_name AS value FROM nation")

# ---- output, control flow and functions that the queries above leave out

_add("print_formatted", "customer", '{ printf "%05d|%-10s|%s\\n", $1, $5, $3 }', "line", "SELECT lpad(c_custkey::VARCHAR, 5, '0') || '|' || rpad(c_mktsegment, greatest(10, length(c_mktsegment))::INT, ' ') || '|' || c_nationkey || chr(10) AS line FROM customer")
_add("empty_action", "nation", '$1 > 20 { } $1 < 2 { print $1 }', "n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey < 2")
_add("next_file_as_next", "nation", "$3 == 2 { nextfile } { print $1 }", "n_nationkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
_add("grouping", "lineitem", "{ print $1, $4, ($5 + 2) * ($7 - 1) / (1 + ($8 * 2)) }", "l_orderkey l_linenumber x", "SELECT l_orderkey, l_linenumber, (l_quantity + 2) * (l_discount - 1) / (1 + l_tax * 2) AS x FROM lineitem")
_add("loop_break_continue", "orders", "{ s = 0; for (i = 1; i <= $1 % 40; i++) { if (i % 3 == 0) continue; if (s > 100) break; s += i } print $1, s }", "o_orderkey s",
     """WITH RECURSIVE t AS (SELECT o_orderkey, 1 AS i, 0 AS s, false AS stop FROM orders UNION ALL
SELECT o_orderkey, i + 1, CASE WHEN i % 3 <> 0 AND s <= 100 THEN s + i ELSE s END, i % 3 <> 0 AND s > 100 FROM t WHERE NOT stop AND i <= o_orderkey % 40)
SELECT o_orderkey::VARCHAR AS o_orderkey, max(s)::VARCHAR AS s FROM t GROUP BY 1""")  # fmt: skip
_add("do_while", "part", "{ n = 0; x = $5; do { x = x - 7; n++ } while (x > 0); print $1, n }", "p_partkey n", "SELECT p_partkey::VARCHAR AS p_partkey, greatest(1, ceil(p_size / 7.0))::INT::VARCHAR AS n FROM part")
_add("nested_loops", "supplier", "{ n = 0; for (i = 0; i < $1 % 9; i++) for (j = i; j < 5; j++) if ((i + j) % 2) n += j; print $1, n }", "s_suppkey n",
     "SELECT s_suppkey::VARCHAR AS s_suppkey, coalesce((SELECT sum(j) FROM range(0, 9) a(i), range(0, 5) b(j) WHERE i < s_suppkey % 9 AND j >= i AND (i + j) % 2 = 1), 0)::INT::VARCHAR AS n FROM supplier")
_add("pair_in_array", "orders", "{ n[$3, $6]++ } END { for (k in n) { split(k, p, SUBSEP); if (k in n) print p[1], p[2], n[k] } }", "status priority n", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2")
_add("pair_asked_first", "events", "!(($3, $4) in seen) { print $1 } { seen[$3, $4]++ }", "event_id", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
_add("delete_elements", "nation", "{ a[$1] = $2; if ($3 == 1) delete a[$1] } END { for (k in a) print k, a[k] }", "n_nationkey n_name", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
_add("last_records", "nation", "{ last[NR % 4] = $2 } END { for (i = NR + 1; i <= NR + 4; i++) print i - NR, last[i % 4] }", "place n_name",
     "SELECT (nr - 21)::INT::VARCHAR AS place, n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS nr FROM nation) WHERE nr > 21")
_add("getline_variable", "nation", "{ if ((getline line) > 0) { split(line, p); print $1, p[1] } }", "a b", "SELECT n_nationkey::VARCHAR AS a, (n_nationkey + 1)::VARCHAR AS b FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 24")
_add("getline_element", "nation", "{ if ((getline got[$1]) > 0) { split(got[$1], p); print $1, p[2] } }", "a b", "SELECT (n.n_nationkey - 1)::VARCHAR AS a, n.n_name AS b FROM nation n WHERE n_nationkey % 2 = 1")
_add("getline_field", "nation", "{ k = $1; if ((getline $2) > 0) print k, (NF > 2) }", "a fields", "SELECT n_nationkey::VARCHAR AS a, '1' AS fields FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 24")
_add("command_into_variable", "region", 'BEGIN { "echo 7 8" | getline line; split(line, p); close("echo 7 8"); done = system("true") } { print $1, p[1] * $1, done }', "r_regionkey x done", "SELECT r_regionkey::VARCHAR AS r_regionkey, (7 * r_regionkey)::VARCHAR AS x, '0' AS done FROM region", allow_shell=True)
_add("arguments", "region", 'BEGIN { n = ARGC; first = ARGV[1]; home = ("PATH" in ENVIRON) } { print $1, n, first, home }', "r_regionkey n first home", "SELECT r_regionkey, 3::DOUBLE AS n, 'x.txt' AS first, 1::DOUBLE AS home FROM region", args=["x.txt", "y.txt"])
_add("random_numbers", "customer", "BEGIN { was = srand(5); was = srand(7) } { r = rand(); print $1, was, r >= 0 && r < 1 }", "c_custkey was inside", "SELECT c_custkey, 7::DOUBLE AS was, 1::DOUBLE AS inside FROM customer")
_add("no_records", "orders", "$4 < 0 { n++; s += $4; m[$3]++ } END { print n + 0, s + 0, length(m) }", "n s kinds", "SELECT 0::DOUBLE AS n, 0::DOUBLE AS s, 0::BIGINT AS kinds")
_add("function_locals", "supplier", "function sum(n, i, total) { total = 0; for (i = 1; i <= n; i++) total += i; return total } { print $1, sum($1 % 10) }", "s_suppkey s", "SELECT s_suppkey::VARCHAR AS s_suppkey, ((s_suppkey % 10) * (s_suppkey % 10 + 1) // 2)::VARCHAR AS s FROM supplier")
_add("function_array", "nation", "function put(a, k, v) { a[k] = v; a[k, 1] = v v } { split(\"\", t); put(t, $1, $2); print length(t), t[$1, 1] }", "n twice", "SELECT '2' AS n, n_name || n_name AS twice FROM nation")
_add("destinations_by_record", "nation", '{ while (n < $1) total += ++n; if (total % 2) print $2 > "odd"; else print $2 >> "even"; if ($1 == 3) print "three" }', "unused",
     "SELECT CASE WHEN (n_nationkey * (n_nationkey + 1) // 2) % 2 = 1 THEN 'odd' ELSE 'even' END AS dest, n_name AS value FROM nation UNION ALL SELECT '', 'three'")
_add("updated_once", "nation", "{ split(\"\", c); y = 0; c[y++]++; c[y++] += 5; c[y--] -= 2; print y, c[0], c[1], c[2], $1 }", "y a b c n_nationkey", "SELECT '1' AS y, '1' AS a, '5' AS b, '-2' AS c, n_nationkey::VARCHAR AS n_nationkey FROM nation")
_add("append_destination", "nation", '{ print $2 >> ("region" $3); fflush("region" $3); close("region" $3) }', "unused", "SELECT 'region' || n_regionkey AS dest, n_name AS value FROM nation")


# ---- set operations: what several programs or operands do


def _combined(name: str, make: Query, sql: str) -> None:
    QUERIES[name] = make
    ORACLE_SQL[name] = sql


def _operands(spark: SparkSession, sf_dir: str, *tables: str) -> Records:
    return Records.concat([records(spark, sf_dir, t) for t in tables])


_combined("union_operands", lambda s, d: Program("{ print $3 }").to_df(_operands(s, d, "customer", "supplier"), ["k"]), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")


def _intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = 'BEGIN { while ((getline line < "supplier") > 0) { split(line, p); t[p[3]] = 1 } } '
    return Program(load + "($3 in t) && !seen[$3]++ { print $3 }").to_df(records(spark, sf_dir, "customer"), ["k"], Config(tables={"supplier": records(spark, sf_dir, "supplier")}))


def _except(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = 'BEGIN { while ((getline line < "orders") > 0) { split(line, p); t[p[2]] = 1 } } '
    return Program(load + "!($1 in t) { print $1 }").to_df(records(spark, sf_dir, "customer"), ["k"], Config(tables={"orders": records(spark, sf_dir, "orders")}))


_combined("intersect", _intersect, "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_combined("except", _except, "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_combined("top_k", lambda s, d: Program('{ print $1, $4 | "sort -k2,2nr -k1,1n | head -10" }').to_df(records(s, d, "orders"), ["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


_combined("two_operands", lambda s, d: Program('NR == FNR { name[$1] = $2; next } $3 in name { print $1, name[$3] }').to_df(_operands(s, d, "nation", "customer"), ["c_custkey", "nation"], Config(posix=True)),
          "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
_combined("numbers_over_operands", lambda s, d: Program("NR > 3 && NR <= 8 { print NR, $2 }").to_df(_operands(s, d, "region", "nation"), ["nr", "name"]),
          "SELECT nr::DOUBLE AS nr, name FROM (SELECT name, row_number() OVER (ORDER BY o, k) AS nr FROM (SELECT 0 AS o, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)) WHERE nr BETWEEN 4 AND 8")


def _as_lines(spark: SparkSession, sf_dir: str, table: str) -> Records:
    """A table as lines of text with | between fields."""
    own = records(spark, sf_dir, table)
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in own.columns])
    return Records(own.df.select(line.alias("value"), "_metadata"), None, own.order)


def _text(name: str, table: str, program: str, sql: str, columns: str = "", **config) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Program(program).to_df(_as_lines(spark, sf_dir, table), columns.split() or None, Config(**{"fs": "|", **config}))

    QUERIES[name] = query
    ORACLE_SQL[name] = sql


_text("text_filter", "lineitem", "$5 > 45 && $9 ~ /[AR]/ { print $1, $4, $9 }", "SELECT l_orderkey || ' ' || l_linenumber || ' ' || l_returnflag AS value FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'R')")
_text("text_group", "lineitem", "{ s[$9 $10] += $5 } END { for (k in s) print k, s[k] }", "SELECT l_returnflag || l_linestatus AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1", "k s")
_text("text_rebuild", "nation", 'BEGIN { OFS = "-" } { $2 = "x"; print; }', "SELECT n_nationkey || '-x-' || n_regionkey AS value FROM nation")
_text("text_strnum", "supplier", "$4 < $1 { print $1 }", "SELECT s_suppkey::VARCHAR AS value FROM supplier WHERE s_acctbal < s_suppkey")
_text("text_fields", "nation", "{ for (i = 1; i <= NF; i++) n[i]++ } END { for (k in n) print k, n[k] }", "SELECT i::INT AS k, (SELECT count(*) FROM nation)::DOUBLE AS n FROM range(1, 4) t(i)", "k n")
