"""Evaluation record by record: for BEGIN on the driver, and for programs that nothing else can express.

Programs become closures over a Machine. Records come from an iterator, output leaves as a
list of pieces of text, or of tuples of values where columns are asked for.
"""

from __future__ import annotations

import csv
import io
import math
import os
import random
import re
import subprocess
import time
from collections.abc import Callable, Iterable, Iterator

from ..errors import CompileError, RunError
from ..functions import regexes
from ..functions.values import Strnum, byte_length, compare, format_number, index, looks_numeric, num, number_prefix, split_fields, sprintf, substitute, substr, text, true
from ..plans import syntax as S
from ..plans.check import arrays_of


class _Next(Exception):
    pass


class _Exit(Exception):
    pass


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Return(Exception):
    def __init__(self, value):
        self.value = value


def _pattern(source: str) -> re.Pattern:
    found = regexes.python(source)
    if found is None:
        raise RunError(f"regular expression {source!r} is not well formed")
    return found


def records(chunks: Iterable[str], rs: str) -> Iterator[str]:
    """Records of a text that comes in chunks, cut at the record separator."""
    rest = ""
    if rs == "":
        body = "".join(chunks).lstrip("\n")
        for part in re.split("\n\n+", body):
            if part.strip("\n"):
                yield part.rstrip("\n")
        return
    for chunk in chunks:
        rest += chunk
        *whole, rest = rest.split(rs)
        for r in whole:
            yield r[:-1] if rs == "\n" and r.endswith("\r") else r
    if rest:
        yield rest[:-1] if rs == "\n" and rest.endswith("\r") else rest


class Machine:
    """A program with its state."""

    def __init__(self, program: S.Program, fs: str | None = None, rs: str | None = None, ofs: str | None = None, ors: str | None = None, variables: dict | None = None, args: list[str] | None = None, posix: bool = False, allow_shell: bool = False, allow_files: bool = True, structured: bool = False, separated: str | None = None, joined: str | None = None):
        self.program = program
        self.arrays_global, self.array_params = arrays_of(program)
        self.g: dict[str, object] = {"FS": fs if fs is not None else " ", "RS": rs if rs is not None else "\n", "OFS": ofs if ofs is not None else " ", "ORS": ors if ors is not None else "\n", "SUBSEP": "\x1c", "CONVFMT": "%.6g", "OFMT": "%.6g", "RSTART": 0.0, "RLENGTH": 0.0, "NR": 0.0, "FNR": 0.0, "FILENAME": ""}
        self.arrays: dict[str, dict[str, object]] = {name: {} for name in self.arrays_global}
        args = ["patternmill", *(args or [])]
        self.g["ARGC"] = float(len(args))
        self.arrays["ARGV"] = {str(i): Strnum(a) for i, a in enumerate(args)}
        self.arrays["ENVIRON"] = {k: Strnum(v) for k, v in os.environ.items()}
        self.posix, self.allow_shell, self.allow_files, self.structured = posix, allow_shell, allow_files, structured
        #: Separators of input and output whose fields may be quoted.
        self.separated, self.joined = separated, joined
        self.record, self.fields = "", []
        self.split_done = True
        self.strings: set[int] = set()  # fields that hold strings, not input
        self.out: list = []
        self.code = 0
        self.source: Iterator | None = None
        self.active: dict[int, bool] = {}
        self.readers: dict[str, Iterator[str]] = {}
        self.written: dict[str, list[str]] = {}
        self.append: set[str] = set()
        self.random, self.seed = random.Random(time.time()), 0.0
        self.random_used = False
        for k, v in (variables or {}).items():
            self.set_global(k, Strnum(v) if posix and isinstance(v, str) else v if isinstance(v, str) else float(v))
        self.scope: S.Function | None = None
        self.functions: dict[str, tuple[S.Function, Callable]] = {}
        for f in program.functions.values():
            self.scope = f
            self.functions[f.name] = (f, self.statement(f.body))
        self.scope = None
        self.begin = [self.statement(b) for b in program.begin]
        self.rules = [self.rule(i, r) for i, r in enumerate(program.rules)]
        self.end = [self.statement(b) for b in program.end]
        self.locals: list = []

    # -- records and fields

    def set_record(self, line: str) -> None:
        self.record, self.split_done = line, False
        self.strings.clear()

    def ready(self) -> list[str]:
        if not self.split_done:
            self.fields = next(csv.reader(self.record.splitlines(keepends=True), delimiter=self.separated), []) if self.separated else split_fields(self.record, text(self.g["FS"]), _pattern)
            self.split_done = True
        return self.fields

    def field(self, k: int):
        if k == 0:
            return self.record if 0 in self.strings else Strnum(self.record)
        fields = self.ready()
        if 0 < k <= len(fields):
            return fields[k - 1] if k in self.strings else Strnum(fields[k - 1])
        return ""

    def set_field(self, k: int, v) -> None:
        if k < 0:
            raise RunError(f"field ${k} does not exist")
        s = text(v, self.g["CONVFMT"])
        if k == 0:
            self.set_record(s)
            if type(v) is str:
                self.strings.add(0)
            return
        fields = self.ready()
        fields += [""] * (k - len(fields))
        fields[k - 1] = s
        (self.strings.add if type(v) is str else self.strings.discard)(k)
        self.rebuild()

    def rebuild(self) -> None:
        self.record = text(self.g["OFS"], self.g["CONVFMT"]).join(self.fields)
        self.strings.discard(0)

    def set_count(self, n: int) -> None:
        fields = self.ready()
        del fields[n:]
        fields += [""] * (n - len(fields))
        self.rebuild()

    def set_global(self, name: str, v) -> None:
        if name == "NF":
            self.set_count(max(0, int(num(v))))
        elif name in ("FS", "RS", "OFS", "ORS", "SUBSEP", "CONVFMT", "OFMT", "FILENAME"):
            self.g[name] = text(v, self.g["CONVFMT"])
        elif name in ("NR", "FNR", "RSTART", "RLENGTH"):
            self.g[name] = num(v)
        else:
            self.g[name] = v

    def advance(self) -> str | None:
        item = next(self.source, None) if self.source is not None else None
        if item is None:
            return None
        line, name = item if isinstance(item, tuple) else (item, None)
        self.g["NR"] += 1.0
        if self.posix and name is not None and name != self.g["FILENAME"]:
            self.g["FILENAME"], self.g["FNR"] = name, 0.0
        self.g["FNR"] += 1.0
        return line

    # -- running

    def run_begin(self) -> bool:
        """False if exit was called."""
        try:
            for b in self.begin:
                b()
        except _Exit:
            return False
        return True

    def run_records(self, source: Iterator) -> None:
        self.source = source
        try:
            while (line := self.advance()) is not None:
                self.set_record(line)
                try:
                    for r in self.rules:
                        r()
                except _Next:
                    pass
        except _Exit:
            pass

    def run_end(self) -> None:
        try:
            for b in self.end:
                b()
        except _Exit:
            pass
        for reader in self.readers.values():
            if hasattr(reader, "close"):
                reader.close()

    def quoted_records(self, chunks: Iterable[str]) -> Iterator[str]:
        """Lines, joined as long as a quoted field goes on over them."""
        held = ""
        for line in records(chunks, "\n"):
            held = f"{held}\n{line}" if held else line
            if held.count('"') % 2 == 0:
                yield held
                held = ""
        if held:
            yield held

    def run(self, source: Iterable) -> str:
        if self.run_begin() and (self.program.rules or self.program.end):
            self.run_records(iter(source))
        self.run_end()
        return "".join(self.out)

    def flush_files(self) -> None:
        """Writes what went to files; only for programs that run on one machine."""
        for name, pieces in self.written.items():
            with open(name, "a" if name in self.append else "w", encoding="utf-8", errors="surrogateescape") as f:
                f.write("".join(pieces))
            self.append.add(name)
            pieces.clear()

    # -- rules and statements

    def rule(self, i: int, r: S.Rule) -> Callable[[], None]:
        body = self.statement(r.body) if r.body is not None else lambda: self.emit([self.field(0)], "\n")
        if r.pattern is None:
            return body
        first = self.test(r.pattern)
        if r.until is None:

            def plain() -> None:
                if first():
                    body()

            return plain
        last = self.test(r.until)

        def ranged() -> None:
            if self.active.get(i):
                if last():
                    self.active[i] = False
                body()
            elif first():
                # The record that opens a range does not close it.
                self.active[i] = True
                if self.posix and last():
                    self.active[i] = False
                body()

        return ranged

    def emit(self, values: list, end: str, dest: tuple[str, str] | None = None) -> None:
        if self.structured and dest is None:
            self.out.append(tuple(values))
            return
        ofmt = self.g["OFMT"]
        if self.joined is not None and len(values) > 1:
            line = io.StringIO()
            csv.writer(line, delimiter=self.joined, lineterminator="").writerow([text(v, ofmt) for v in values])
            self.put(line.getvalue() + end, dest)
            return
        piece = self.g["OFS"].join(text(v, ofmt) for v in values) + end
        self.put(piece, dest)

    def put(self, piece: str, dest: tuple[str, str] | None) -> None:
        if dest is None:
            self.out.append(piece)
            return
        how, name = dest
        if how == "|":
            if not self.allow_shell:
                raise RunError("pipes need allow_shell")
            self.written.setdefault(f"|{name}", []).append(piece)
        elif name in ("/dev/stdout", "-"):
            self.out.append(piece)
        else:
            if how == ">>" and name not in self.written:
                self.append.add(name)
            self.written.setdefault(name, []).append(piece)

    def statement(self, s: S.Node) -> Callable[[], None]:
        if isinstance(s, S.Block):
            body = [self.statement(x) for x in s.body]
            if len(body) == 1:
                return body[0]

            def block() -> None:
                for x in body:
                    x()

            return block
        if isinstance(s, S.Expr):
            return self.expr(s.value)
        if isinstance(s, S.Print):
            return self.output(s)
        if isinstance(s, S.If):
            test, yes = self.test(s.test), self.statement(s.yes)
            no = self.statement(s.no) if s.no is not None else lambda: None

            def branch() -> None:
                yes() if test() else no()

            return branch
        if isinstance(s, S.While):
            test, body, at_end = self.test(s.test), self.statement(s.body), s.at_end

            def loop() -> None:
                first = at_end
                while first or test():
                    first = False
                    try:
                        body()
                    except _Break:
                        break
                    except _Continue:
                        continue

            return loop
        if isinstance(s, S.For):
            init = self.statement(s.init) if s.init is not None else lambda: None
            test = self.test(s.test) if s.test is not None else lambda: True
            step = self.statement(s.step) if s.step is not None else lambda: None
            body = self.statement(s.body)

            def counted() -> None:
                init()
                while test():
                    try:
                        body()
                    except _Break:
                        break
                    except _Continue:
                        pass
                    step()

            return counted
        if isinstance(s, S.ForIn):
            array, put, body = self.array(s.array), self.setter(S.Var(s.name)), self.statement(s.body)

            def each() -> None:
                own = array()
                for k in list(own):
                    if k in own:
                        put(k)
                        try:
                            body()
                        except _Break:
                            break
                        except _Continue:
                            pass

            return each
        if isinstance(s, S.Delete):
            array = self.array(s.array)
            if s.keys is None:
                return lambda: array().clear()
            key = self.key(s.keys)
            return lambda: array().pop(key(), None)
        if isinstance(s, S.Jump):
            kind = {"next": _Next, "nextfile": _Next, "break": _Break, "continue": _Continue}[s.kind]
            if s.kind == "nextfile" and self.posix:
                raise CompileError("nextfile by file needs whole files; use sources")

            def jump() -> None:
                raise kind

            return jump
        if isinstance(s, S.Exit):
            code = self.expr(s.code) if s.code is not None else None

            def leave() -> None:
                if code is not None:
                    self.code = int(num(code())) & 255
                raise _Exit

            return leave
        if isinstance(s, S.Return):
            value = self.expr(s.value) if s.value is not None else lambda: None

            def back() -> None:
                raise _Return(value())

            return back
        raise CompileError(f"unknown statement {type(s).__name__}")

    def output(self, s: S.Print) -> Callable[[], None]:
        args = [self.expr(a) for a in s.args]
        to = self.expr(s.to) if s.to is not None else None

        def dest() -> tuple[str, str] | None:
            return None if to is None else (s.how, text(to()))

        if s.formatted:

            def formatted() -> None:
                first, *rest = [a() for a in args]
                piece = sprintf(text(first), rest)
                self.out.append((piece,)) if self.structured and to is None else self.put(piece, dest())

            return formatted
        if not args:
            return lambda: self.emit([self.field(0)], self.g["ORS"], dest())
        return lambda: self.emit([a() for a in args], self.g["ORS"], dest())

    # -- names

    def local(self, name: str) -> int:
        return self.scope.params.index(name) if self.scope and name in self.scope.params else -1

    def array(self, name: str) -> Callable[[], dict]:
        at = self.local(name)
        if at < 0:
            self.arrays.setdefault(name, {})
            return lambda: self.arrays[name]

        def own() -> dict:
            frame = self.locals[-1]
            if frame[at] is None:
                frame[at] = {}
            return frame[at]

        return own

    def key(self, keys: tuple[S.Node, ...]) -> Callable[[], str]:
        parts = [self.expr(k) for k in keys]
        if len(parts) == 1:
            one = parts[0]
            return lambda: str(text(one(), self.g["CONVFMT"]))
        return lambda: self.g["SUBSEP"].join(text(p(), self.g["CONVFMT"]) for p in parts)

    def setter(self, target: S.Node) -> Callable[[object], None]:
        if isinstance(target, S.Var):
            at = self.local(target.name)
            if at >= 0:

                def put(v) -> None:
                    self.locals[-1][at] = v

                return put
            name = target.name
            if name in self.g or name == "NF":
                return lambda v: self.set_global(name, v)

            def put_global(v) -> None:
                self.g[name] = v

            return put_global
        if isinstance(target, S.Index):
            array, key = self.array(target.array), self.key(target.keys)

            def put_item(v) -> None:
                array()[key()] = v

            return put_item
        index_of = self.expr(target.index)
        return lambda v: self.set_field(int(num(index_of())), v)

    def place(self, target: S.Node) -> Callable[[], tuple[Callable[[], object], Callable[[object], None]]]:
        """Where an updated value stands: its reader and writer, with the subscript evaluated once."""
        if isinstance(target, S.Index):
            array, key = self.array(target.array), self.key(target.keys)

            def item():
                own, k = array(), key()
                return lambda: own.setdefault(k, ""), lambda v: own.__setitem__(k, v)

            return item
        if isinstance(target, S.Field) and not isinstance(target.index, S.Num):
            at = self.expr(target.index)

            def field():
                k = int(num(at()))
                return lambda: self.field(k), lambda v: self.set_field(k, v)

            return field
        fixed = self.expr(target), self.setter(target)
        return lambda: fixed

    # -- expressions

    def test(self, e: S.Node) -> Callable[[], bool]:
        value = self.expr(e)
        return lambda: true(value())

    def matcher(self, e: S.Node) -> Callable[[], re.Pattern | None]:
        """A regular expression operand: a literal, or a string that is read as one."""
        while isinstance(e, S.Group) and len(e.items) == 1:
            e = e.items[0]
        if isinstance(e, S.Regex):
            fixed = regexes.python(e.source)
            return lambda: fixed
        value = self.expr(e)
        return lambda: regexes.python(text(value(), self.g["CONVFMT"]))

    def expr(self, e: S.Node) -> Callable[[], object]:
        made = getattr(self, f"_{type(e).__name__.lower()}", None)
        if made is None:
            raise CompileError(f"unknown expression {type(e).__name__}")
        return made(e)

    def _num(self, e: S.Num):
        v = e.value
        return lambda: v

    def _str(self, e: S.Str):
        v = e.value
        return lambda: v

    def _regex(self, e: S.Regex):
        p = regexes.python(e.source)
        return lambda: 1.0 if p is not None and p.search(self.record) else 0.0

    def _group(self, e: S.Group):
        if len(e.items) > 1:
            parts = [self.expr(x) for x in e.items]
            return lambda: self.g["SUBSEP"].join(text(p(), self.g["CONVFMT"]) for p in parts)
        return self.expr(e.items[0])

    def _var(self, e: S.Var):
        at = self.local(e.name)
        if at >= 0:
            return lambda: self.locals[-1][at]
        name = e.name
        if name == "NF":
            return lambda: float(len(self.ready()))
        return lambda: self.g.get(name)

    def _index(self, e: S.Index):
        array, key = self.array(e.array), self.key(e.keys)
        return lambda: array().setdefault(key(), "")

    def _field(self, e: S.Field):
        if isinstance(e.index, S.Num):
            k = int(e.index.value)
            return lambda: self.field(k)
        at = self.expr(e.index)
        return lambda: self.field(int(num(at())))

    def _unary(self, e: S.Unary):
        value = self.expr(e.operand)
        if e.op == "!":
            return lambda: 0.0 if true(value()) else 1.0
        return (lambda: -num(value())) if e.op == "-" else (lambda: num(value()))

    def _binary(self, e: S.Binary):
        a, b = self.expr(e.left), self.expr(e.right)
        if e.op == " ":
            return lambda: text(a(), self.g["CONVFMT"]) + text(b(), self.g["CONVFMT"])
        if e.op == "&&":
            return lambda: 1.0 if true(a()) and true(b()) else 0.0
        if e.op == "||":
            return lambda: 1.0 if true(a()) or true(b()) else 0.0
        if e.op in COMPARE:
            holds = COMPARE[e.op]
            return lambda: 1.0 if holds(compare(a(), b())) else 0.0
        do = ARITHMETIC[e.op]
        return lambda: do(num(a()), num(b()))

    def _match(self, e: S.Match):
        value, pattern, negated = self.expr(e.left), self.matcher(e.right), e.negated

        def run() -> float:
            s, p = text(value(), self.g["CONVFMT"]), pattern()
            return float((p is not None and p.search(s) is not None) != negated)

        return run

    def _in(self, e: S.In):
        array, key = self.array(e.array), self.key(e.keys)
        return lambda: 1.0 if key() in array() else 0.0

    def _cond(self, e: S.Cond):
        test, yes, no = self.test(e.test), self.expr(e.yes), self.expr(e.no)
        return lambda: yes() if test() else no()

    def _assign(self, e: S.Assign):
        value = self.expr(e.value)
        if e.op == "=":
            put = self.setter(e.target)

            def assign():
                v = value()
                put(v)
                return v

            return assign
        place, do = self.place(e.target), ARITHMETIC[e.op[0]]

        def augment() -> float:
            x = num(value())
            old, put = place()
            v = do(num(old()), x)
            put(v)
            return v

        return augment

    def _step(self, e: S.Step):
        place, by, pre = self.place(e.target), 1.0 if e.op == "++" else -1.0, e.pre

        def step() -> float:
            old, put = place()
            x = num(old())
            put(x + by)
            return x + by if pre else x

        return step

    def _call(self, e: S.Call):
        f = self.program.functions[e.name]
        arrays = self.array_params[e.name]
        args: list[Callable] = []
        for param, a in zip(f.params, e.args, strict=False):
            args.append(self.array(a.name) if param in arrays and isinstance(a, S.Var) else self.expr(a))
        missing = [None] * (len(f.params) - len(args))

        def call():
            frame = [a() for a in args] + missing[:]
            if len(self.locals) > 800:
                raise RunError(f"function {f.name} calls itself too deeply")
            self.locals.append(frame)
            try:
                self.functions[f.name][1]()
            except _Return as r:
                return r.value
            finally:
                self.locals.pop()
            return None

        return call

    def _getline(self, e: S.Getline):
        put = self.setter(e.target) if e.target is not None else None
        source = self.expr(e.source) if e.source is not None else None

        def run() -> float:
            if source is None:
                line = self.advance()
            else:
                name = text(source())
                try:
                    line = next(self.reader(name, e.how), None)
                except OSError:
                    return -1.0
                if line is not None and not self.posix and e.how == "<":
                    self.g["NR"] += 1.0
                    self.g["FNR"] += 1.0
            if line is None:
                return 0.0
            if put is None:
                self.set_record(line)
            else:
                put(Strnum(line) if self.posix else line)
            return 1.0

        return run

    def reader(self, name: str, how: str) -> Iterator[str]:
        at = f"{how}{name}"
        if at not in self.readers:
            if how == "|":
                if not self.allow_shell:
                    raise RunError("commands need allow_shell")
                got = subprocess.run(["sh", "-c", name], capture_output=True, check=False).stdout.decode("utf-8", "surrogateescape")
                self.readers[at] = records([got], text(self.g["RS"]))
            else:
                if not self.allow_files:
                    raise RunError("files are read on the driver only")
                f = open(name, encoding="utf-8", errors="surrogateescape")  # noqa: SIM115
                self.readers[at] = records(f, text(self.g["RS"]))
        return self.readers[at]

    def _builtin(self, e: S.Builtin):
        return getattr(self, f"do_{e.name}")(e.args)

    # -- built-in functions

    def _float1(self, args, do):
        x = self.expr(args[0])

        def run() -> float:
            try:
                return do(num(x()))
            except OverflowError:
                return math.inf

        return run

    def do_sin(self, args):
        return self._float1(args, lambda x: math.nan if math.isinf(x) else math.sin(x))

    def do_cos(self, args):
        return self._float1(args, lambda x: math.nan if math.isinf(x) else math.cos(x))

    def do_exp(self, args):
        return self._float1(args, math.exp)

    def do_log(self, args):
        return self._float1(args, lambda x: -math.inf if x == 0 else math.nan if x < 0 else math.log(x))

    def do_sqrt(self, args):
        return self._float1(args, lambda x: math.nan if x < 0 else math.sqrt(x))

    def do_int(self, args):
        return self._float1(args, lambda x: x if math.isinf(x) or x != x else float(math.trunc(x)))

    def do_atan2(self, args):
        a, b = self.expr(args[0]), self.expr(args[1])
        return lambda: math.atan2(num(a()), num(b()))

    def do_rand(self, args):
        return lambda: self.random.random()

    def do_srand(self, args):
        seed = self.expr(args[0]) if args else lambda: float(int(time.time()))

        def run() -> float:
            self.seed = num(seed())
            self.random.seed(self.seed)
            return self.seed

        return run

    def do_length(self, args):
        if not args:
            return lambda: float(byte_length(self.record))
        a = args[0]
        if isinstance(a, S.Var):
            scope = self.array_params[self.scope.name] if self.scope and a.name in self.scope.params else self.arrays_global
            if a.name in scope:
                array = self.array(a.name)
                return lambda: float(len(array()))
        value = self.expr(a)
        return lambda: float(byte_length(text(value(), self.g["CONVFMT"])))

    def do_index(self, args):
        a, b = self.expr(args[0]), self.expr(args[1])
        return lambda: float(index(text(a(), self.g["CONVFMT"]), text(b(), self.g["CONVFMT"])))

    def do_substr(self, args):
        s, m = self.expr(args[0]), self.expr(args[1])
        n = self.expr(args[2]) if len(args) > 2 else None
        return lambda: substr(text(s(), self.g["CONVFMT"]), num(m()), None if n is None else num(n()))

    def do_tolower(self, args):
        s = self.expr(args[0])
        return lambda: str(text(s(), self.g["CONVFMT"])).lower()

    def do_toupper(self, args):
        s = self.expr(args[0])
        return lambda: str(text(s(), self.g["CONVFMT"])).upper()

    def do_sprintf(self, args):
        parts = [self.expr(a) for a in args]

        def run() -> str:
            first, *rest = [p() for p in parts]
            return sprintf(text(first), rest)

        return run

    def do_match(self, args):
        s, pattern = self.expr(args[0]), self.matcher(args[1])

        def run() -> float:
            own, p = text(s(), self.g["CONVFMT"]), pattern()
            m = p.search(own) if p else None
            self.g["RSTART"] = float(byte_length(own[: m.start()]) + 1) if m else 0.0
            self.g["RLENGTH"] = float(byte_length(m[0])) if m else -1.0
            return self.g["RSTART"]

        return run

    def do_split(self, args):
        s, array = self.expr(args[0]), self.array(args[1].name)
        sep = None
        if len(args) > 2:
            own = args[2].items[0] if isinstance(args[2], S.Group) else args[2]
            if isinstance(own, S.Regex):
                p = _pattern(own.source)
                sep = lambda: p
            else:
                sep = self.expr(own)

        def run() -> float:
            whole = text(s(), self.g["CONVFMT"])
            by = sep() if sep else self.g["FS"]
            if not whole:
                parts = []
            elif isinstance(by, re.Pattern):
                parts = by.split(whole)
            else:
                by = text(by, self.g["CONVFMT"])
                parts = list(whole) if by == "" else whole.split() if by == " " else split_fields(whole, by, _pattern)
            own = array()
            own.clear()
            for i, part in enumerate(parts, 1):
                own[str(i)] = Strnum(part) if self.posix else str(part)
            return float(len(parts))

        return run

    def _replace(self, args, every: bool):
        pattern, by = self.matcher(args[0]), self.expr(args[1])
        place = self.place(args[2] if len(args) > 2 else S.Field(S.Num(0.0)))

        def run() -> float:
            p, template = pattern(), text(by(), self.g["CONVFMT"])
            old, put = place()
            s = text(old(), self.g["CONVFMT"])
            n, out = substitute(p, template, s, every) if p is not None else (0, s)
            put(str(out))
            return float(n)

        return run

    def do_sub(self, args):
        return self._replace(args, False)

    def do_gsub(self, args):
        return self._replace(args, True)

    def do_close(self, args):
        name = self.expr(args[0])

        def run() -> float:
            n = text(name())
            found = False
            for how in ("<", "|"):
                found |= self.readers.pop(f"{how}{n}", None) is not None
            if n in self.written:
                self.flush_files()
                found = True
            return 0.0 if found else -1.0

        return run

    def do_fflush(self, args):
        return lambda: 0.0

    def do_system(self, args):
        command = self.expr(args[0])

        def run() -> float:
            if not self.allow_shell:
                raise RunError("system needs allow_shell")
            got = subprocess.run(["sh", "-c", text(command())], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, check=False)
            self.out.append(got.stdout.decode("utf-8", "surrogateescape"))
            return float(got.returncode)

        return run


def _divide(a: float, b: float) -> float:
    if b == 0:
        raise RunError("division by zero")
    return a / b


def _modulo(a: float, b: float) -> float:
    if b == 0:
        raise RunError("division by zero")
    return math.nan if math.isinf(a) else math.fmod(a, b)


def _power(a: float, b: float) -> float:
    try:
        out = a**b
    except OverflowError:
        return math.inf
    except ZeroDivisionError:
        return math.inf
    return out if isinstance(out, float) else math.nan


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "%": _modulo, "^": _power}
COMPARE = {
    "==": lambda c: c == 0,
    "!=": lambda c: c != 0,
    "<": lambda c: c is not None and c < 0,
    "<=": lambda c: c is not None and c <= 0,
    ">": lambda c: c is not None and c > 0,
    ">=": lambda c: c is not None and c >= 0,
}

__all__ = ["Machine", "records", "format_number", "looks_numeric", "number_prefix"]
