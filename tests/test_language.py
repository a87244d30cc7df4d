"""Programs and what they print, run by the evaluator."""

import pytest

import patternmill as P

CASES = [
    ("BEGIN { a[i++]++; print i, a[0], length(a) }", "", "1 1 1\n"),
    ("BEGIN { a[i++] += 7; a[i++] -= 2; print i, a[0], a[1] }", "", "2 7 -2\n"),
    ("{ $(k++)++; print k }", "4 5\n", "1\n"),
    ("{ $(k += 1) *= 3; print k, $0 }", "4 5\n", "1 12 5\n"),
    ('{ n = sub(/b/, "c", a[i++]); print i, n }', "x\n", "1 0\n"),
    ("{ $$0++; print }", "3 8 9\n", "4\n"),
    ("{ $i++; print; print i + 0 }", "3 8\n", "4\n0\n"),
    ("BEGIN { print RSTART, RLENGTH; RSTART = 3; RLENGTH = 9; print RSTART, RLENGTH }", "", "0 0\n3 9\n"),
    (r'BEGIN { print "\303\251" == "é", length("\xe9"), length("\777"), length("\x41\377") }', "", "1 1 1 2\n"),
    ("{ print $2 }", "a b\nc d\n", "b\nd\n"),
    ("{ s += $1 } END { print s, s / NR }", "1\n2\n4\n", "7 2.33333\n"),
    ("!seen[$0]++", "a\nb\na\n", "a\nb\n"),
    ("/b/, /d/", "a\nb\nc\nd\ne\n", "b\nc\nd\n"),
    ("/a/, /a/", "a\nb\na\nb\n", "a\nb\na\n"),
    ('BEGIN { printf "%5.2f|%-5s|%05d|%x|%c\\n", 3.14159, "ab", 42, 255, 65 }', "", " 3.14|ab   |00042|ff|A\n"),
    ('BEGIN { printf "%.2f %.0f %g %5s%%\\n", 1.005, 2.5, 0.0001, "x" }', "", "1.00 2 0.0001     x%\n"),
    ('{ gsub(/o/, "[&]"); print; print gsub(/x/, "y"), $1 }', "foo boo\n", "f[o][o] b[o][o]\n0 f[o][o]\n"),
    (r'{ gsub(/o/, "\\&"); print }', "foo\n", "f&&\n"),
    ('{ sub(/l+/, "<&&>"); print }', "hello ll\n", "he<llll>o ll\n"),
    ("function f(n) { return n <= 1 ? 1 : n * f(n - 1) } BEGIN { print f(10), 2 ^ 10, 2 ^ 3 ^ 2, -2 ^ 2 }", "", "3628800 1024 512 -4\n"),
    ("function g(a, k) { a[k] = 1 } BEGIN { g(x, 3); for (k in x) print k, length(x) }", "", "3 1\n"),
    ('{ $3 = "x"; print NF; print }', "a b\n", "3\na b x\n"),
    ('{ $5 = "e"; print; print NF }', "a b\n", "a b   e\n5\n"),
    ('BEGIN { OFS = "-" } { $1 = $1; print }', "a b c\n", "a-b-c\n"),
    ("{ NF = 2; print; print $3 }", "a b c\n", "a b\n\n"),
    ('{ n = split($0, a, ","); for (i = n; i > 0; i--) printf "%s ", a[i]; print "" }', "1,2,3\n", "3 2 1 \n"),
    ('BEGIN { n = split("abc", a, ""); print n, a[1], a[3] }', "", "3 a c\n"),
    ('BEGIN { print substr("hello", 0, 2), substr("hello", 2), substr("hello", 4, 9) "|" substr("hello", 9) }', "", "he ello lo|\n"),
    ('BEGIN { print index("abc", "c"), index("abc", ""), match("xaab", /a+/), RSTART, RLENGTH, match("x", /y/), RLENGTH }', "", "3 1 2 2 2 0 -1\n"),
    ('BEGIN { print length("héé"), toupper("abc"), tolower("ABC"), length() }', "", "5 ABC abc 0\n"),
    ("$1 == 1", "1\n1.0\n+1\n10x\n", "1\n1.0\n+1\n"),
    ("$1 < 2", "10x\n10\n1\n", "10x\n1\n"),
    ("{ print ($9 == 0), ($1 == 0) }", "0\n", "0 1\n"),
    ('BEGIN { print x == 0, x == "", a["k"] == 0, a["k"] == "" }', "", "1 1 0 1\n"),
    ('BEGIN { print 1 == 1.0, "10" < "9", 10 < 9, "a" < "b" }', "", "1 1 0 1\n"),
    ("BEGIN { while (i < 5) { i++; if (i == 2) continue; if (i == 4) break; print i } }", "", "1\n3\n"),
    ("BEGIN { do { print i++ } while (i < 2) }", "", "0\n1\n"),
    ("BEGIN { for (;;) { if (++n > 3) break } print n }", "", "4\n"),
    ('{ print; getline; print "then " $0 }', "a\nb\nc\n", "a\nthen b\nc\nthen c\n"),
    ("{ getline x; print $0 x, NR }", "a\nb\n", "ab 2\n"),
    ("END { print NR, $0, NF }", "a\nb c\n", "2 b c 2\n"),
    ("NR == 1 { next } { print }", "a\nb\n", "b\n"),
    ('BEGIN { a["x"]; delete a["x"]; print length(a), ("x" in a) }', "", "0 0\n"),
    ('BEGIN { a[1, 2] = 3; for (k in a) { split(k, p, SUBSEP); print p[1] + p[2], ((1, 2) in a) } }', "", "3 1\n"),
    ("BEGIN { print -3 % 2, 7 % 3, !0, 1 \" \" 2, 1 - 1, 1e6, 1e300 * 1e300, log(0), int(-3.7), int(\"3x\") }", "", "-1 1 1 1 2 0 1000000 inf -inf -3 3\n"),
    ("BEGIN { print 0x10, 011, \"0x1A\" + 0, \".5.\" + 0, \"nancy\" + 0 }", "", "16 11 26 0.5 nan\n"),
    ('BEGIN { CONVFMT = "%.2g"; x = 3.14159; y = x ""; print y, x }', "", "3.1 3.14159\n"),
    ('BEGIN { OFMT = "%.2f"; print 3.14159, 3 }', "", "3.14 3\n"),
    ("BEGIN { x = 5; x += x++; print x; y = z++ + ++z; print y }", "", "11\n2\n"),
    ("BEGIN { print 1, 2 > \"/dev/stdout\" }", "", "1 2\n"),
    ('BEGIN { print("a" "b"), (1)(2); print (1, 2) }', "", "ab 12\n1 2\n"),
    ("BEGIN { print srand(5), srand(7) }", "", "5 7\n"),
    ("BEGIN { r = rand(); print (r >= 0 && r < 1) }", "", "1\n"),
    ("BEGIN { x[1]; if (!(2 in x)) print \"no\"; print 1 in x }", "", "no\n1\n"),
    ('{ x = $1 ~ /^[[:alpha:]]+$/; y = $1 !~ "b"; print x, y }', "abc\n12\n", "1 0\n0 1\n"),
    ('BEGIN { print "a\\tb\\x41\\101\\/" }', "", "a\tbAA/\n"),
    ("/a|ab/ { match($0, /a|ab/); print RLENGTH }", "ab\n", "2\n"),
    ("BEGIN { exit } END { print \"end\" }", "x\n", "end\n"),
    ("# comment\nBEGIN { x = 1 ; # more\n print x }\n\n", "", "1\n"),
    ("BEGIN { if (1) ; else print 2; print 3 }", "", "3\n"),
    ("BEGIN { if (0) print 1\nelse print 2 }", "", "2\n"),
    ('BEGIN { "echo hi" | getline x; print x }', "", "hi\n"),
    ('BEGIN { print "b\\na" | "sort" }', "", "a\nb\n"),
    ("BEGIN { print system(\"exit 3\") }", "", "3\n"),
]


@pytest.mark.parametrize("program,given,printed", CASES, ids=[c[0][:40] for c in CASES])
def test_prints(program, given, printed):
    assert P.run(program, given, P.Config(allow_shell=True)) == printed


@pytest.mark.parametrize(
    "given,config,printed",
    [
        ("a:b\nc:d\n", P.Config(fs=":"), "b\nd\n"),
        ("a,,b\n", P.Config(fs=","), "\n"),
        ("a1b22c\n", P.Config(fs="[0-9]+"), "b\n"),
        ("a|b\n", P.Config(fs="|"), "b\n"),
    ],
)
def test_separators(given, config, printed):
    assert P.run("{ print $2 }", given, config) == printed


def test_records():
    assert P.run("{ print NR \":\" $1 }", "a b|c d|", P.Config(rs="|")) == "1:a\n2:c\n"
    assert P.run('BEGIN { RS = ""; FS = "\\n" } { print NF, $1 }', "1\n2\n\na\nb\nc\n") == "2 1\n3 a\n"
    assert P.run("{ print length }", "ab\r\nc\r\n") == "2\n1\n"


def test_files(tmp_path):
    (tmp_path / "in").write_text("1 x\n2 y\n")
    program = f'BEGIN {{ while ((getline l < "{tmp_path}/in") > 0) {{ split(l, p); t[p[1]] = p[2] }} }} $1 in t {{ print t[$1] > "{tmp_path}/out" }}'
    P.run(program, "2\n3\n1\n")
    assert (tmp_path / "out").read_text() == "y\nx\n"
    assert P.run('BEGIN { print (getline l < "/nowhere") }') == "-1\n"


def test_variables_and_args():
    assert P.run('{ print $1 > "/dev/stdout"; print ($1 > t) }', "9\n", P.Config(variables={"t": "10"})) == "9\n1\n"
    assert P.run("BEGIN { print ARGC, ARGV[1] }", "", P.Config(args=["f"])) == "2 f\n"


def test_exit_status():
    with pytest.raises(P.ExitStatus) as e:
        P.run("NR == 2 { exit 3 } { print } END { print \"e\" }", "a\nb\n")
    assert e.value.code == 3 and e.value.output == "a\ne\n" and P.is_exit(e.value) == (True, 3)


@pytest.mark.parametrize("program", ["BEGIN { print 1 / 0 }", "BEGIN { x = 0; print 1 % x }", "BEGIN { $-1 = 2 }", 'BEGIN { system("true") }'])
def test_run_errors(program):
    with pytest.raises(P.RunError):
        P.run(program, "")


@pytest.mark.parametrize("program", ["{ print", "BEGIN", "{ next } END { next }", "function f(a, a) { }", "{ print 1 + }", "{ break }", "{ return 1 }", "BEGIN { /x }", '{ print "a }', "{ substr(1) }", "{ sub(/a/, \"b\", 3) }", "BEGIN { a[] }", "BEGIN { delete a[] }"])
def test_parse_errors(program):
    with pytest.raises(P.ParseError):
        P.compile(program)


@pytest.mark.parametrize("program", ["{ f(1) }", "{ a[1] = 2; a = 3 }", "function f(x) { return x } { print f(1, 2) }", "function f(a) { a[1] = 1 } { x = 1; f(x) }"])
def test_compile_errors(program):
    with pytest.raises(P.CompileError):
        P.compile(program)


def test_command_line(tmp_path, capsys):
    from patternmill.cli import main

    (tmp_path / "p").write_text("{ print x, $2 }\n")
    (tmp_path / "d").write_text("a:b\n")
    assert main(["-F:", "-v", "x=1", "-f", str(tmp_path / "p"), str(tmp_path / "d")]) == 0
    assert capsys.readouterr().out == "1 b\n"
    assert main(["BEGIN { exit 4 }"]) == 4
    assert main(["BEGIN {"]) == 2


def test_quoted_fields(tmp_path, capsys):
    """csv and tsv on both sides, a header, and quoted fields that hold separators and newlines."""
    from patternmill.cli import main

    (tmp_path / "d.csv").write_text('name,note\n"a, b","x ""y"""\nc,"two\nlines"\n')
    assert main(["-i", "csv", "-ocsv", "-H", "{ print NF, $2, $1 }", str(tmp_path / "d.csv")]) == 0
    assert capsys.readouterr().out == '2,"x ""y""","a, b"\n2,"two\nlines",c\n'
    assert main(["-itsv", "{ print $2 }", str(tmp_path / "d.csv")]) == 0
    assert main(["-i", "xml", "1"]) == 2
    capsys.readouterr()
    assert main(["-j", "2", "NR == 1 { print; exit 4 }", str(tmp_path / "d.csv")]) == 4
    assert capsys.readouterr().out == "name,note\n"
    assert main(["-dt", "function f(a, b) { a[b] = 1 } { f(x, y); z++ }"]) == 0
    shown = capsys.readouterr().out.splitlines()
    assert "x: array" in shown and "z: scalar" in shown and shown[-1] == "f(a[], b)"
    assert main(["-dp", "{ n++; m = 1; print m }"]) == 0
    assert capsys.readouterr().out.endswith("record to record: n\n")


def test_output_as_it_goes():
    """run() writes to config.output instead of holding what is printed."""
    import io

    out = io.StringIO()
    assert P.run("{ print $1 * 2 }", "".join(f"{i}\n" for i in range(10_000)), P.Config(output=out)) == ""
    assert out.getvalue() == "".join(f"{2 * i}\n" for i in range(10_000))
