"""The command line: patternmill [options] 'program' [file ...]

-F separator, -v name=value, -f program file, -j N (plan on Spark with N threads),
-i csv|tsv, -o csv|tsv (quoted fields in the input, or in what print writes), -H (skip the
first record), -c (accepted), -da prints the syntax tree, -dt the names and whether they are
arrays, -dp what lasts from record to record, --version, --. Files are read in order; - is the
standard input. With -j, programs that give an exit code run without Spark, which has none.
"""

from __future__ import annotations

import sys

from .api import Config, Program
from .errors import ExitStatus, PatternmillError
from .operators.sequential import records
from .plans.check import arrays_of
from .plans.flow import lasting
from .plans.syntax import Exit, Var, unescape, walk

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    fs, variables, sources, threads, dump, posix = None, {}, [], 0, "", False
    modes: dict = {}
    while args and args[0].startswith("-") and args[0] != "-":
        a = args.pop(0)
        if a == "--":
            break
        if a in ("-h", "--help"):
            print(__doc__)
            return 0
        if a in ("-version", "--version"):
            print(VERSION)
            return 0
        if a in ("--posix", "--no-posix"):
            posix = a == "--posix"
        elif a in ("-d", "-da", "-dt", "-dp"):
            dump = a
        elif a in ("-H", "-c"):
            modes |= {"header": True} if a == "-H" else {}
        elif a[:2] in ("-F", "-v", "-f", "-j", "-i", "-o"):
            value = a[2:] or (args.pop(0) if args else None)
            if value is None:
                print(f"{a} needs a value", file=sys.stderr)
                return 2
            if a[1] == "F":
                fs = "\t" if value == "t" else unescape(value)
            elif a[1] in "io":
                if value not in ("csv", "tsv"):
                    print(f"{a[:2]} is csv or tsv", file=sys.stderr)
                    return 2
                modes["input_mode" if a[1] == "i" else "output_mode"] = value
            elif a[1] == "v":
                name, _, text = value.partition("=")
                variables[name] = unescape(text)
            elif a[1] == "f":
                sources.append(sys.stdin.read() if value == "-" else open(value, encoding="utf-8").read())  # noqa: SIM115
            else:
                threads = int(value)
        else:
            print(f"unknown option {a}", file=sys.stderr)
            return 2
    if not sources:
        if not args:
            print(__doc__, file=sys.stderr)
            return 2
        sources.append(args.pop(0))
    config = Config(fs=fs, variables=variables, args=args, posix=posix, allow_shell=True, output=sys.stdout, parallel=threads, **modes)
    try:
        program = Program("\n".join(sources))
        if dump:
            print(_dumped(program, dump))
            return 0
        codes = any(isinstance(n, Exit) and n.code is not None for n in walk(program.tree))
        if threads > 1 and args and "-" not in args and not modes and not codes:
            return _on_spark(program, args, config, threads)
        program.run(_lines(args), config)
        return 0
    except ExitStatus as e:
        return e.code
    except (PatternmillError, OSError) as e:
        print(f"patternmill: {e}", file=sys.stderr)
        return 2


def _dumped(program: Program, what: str) -> object:
    if what == "-dt":
        arrays, params = arrays_of(program.tree)
        names = sorted({n.name for n in walk(program.tree) if isinstance(n, Var)} | arrays)
        return "\n".join([f"{n}: {'array' if n in arrays else 'scalar'}" for n in names] + [f"{f}({', '.join(p + '[]' * (p in params[f]) for p in g.params)})" for f, g in sorted(program.tree.functions.items())])
    if what == "-dp":
        names = lasting(program.tree)
        return f"lasts from record to record: {', '.join(sorted(names))}" if names else "records do not depend on each other"
    return program.tree


def _lines(paths: list[str]):
    for p in paths or ["-"]:
        if p == "-":
            yield from sys.stdin
        else:
            with open(p, encoding="utf-8", errors="surrogateescape") as f:
                yield from f


def _on_spark(program: Program, paths: list[str], config: Config, threads: int) -> int:
    from pyspark.sql import SparkSession

    from .api import read

    spark = SparkSession.builder.master(f"local[{threads}]").getOrCreate()
    plan = program.plan(read(spark, paths, config), config)
    sys.stdout.write("".join(plan.begun.out))
    for row in plan.df.toLocalIterator():
        print(row["value"])
    return 0


__all__ = ["main", "records"]
