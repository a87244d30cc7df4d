"""Rules whose records do not depend on each other, run on whole Arrow batches by numpy.

A statement runs on the numbers of the rows that reach it: a branch on those that pass its
test, a loop's body on those whose test still holds, so a loop ends when its last row does
and costs what its rows' steps cost together. Variables are numbers, one array each; strings
come from fields and constants and are printed, joined, compared with strings or read as
numbers. Whatever else a program does raises Unbatchable, and its records go through the
evaluator one by one. Numbers of a table are read as they are stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import PatternmillError, RunError
from ..functions import regexes
from ..functions.values import Strnum, compare, format_number, num, split_fields, sprintf, text, true
from ..plans import syntax as S
from .sequential import COMPARE as _HOLDS

Rows = np.ndarray
#: (kind, function of rows); kinds: num, str, input (a string that may look like a number) and null.
Value = tuple[str, Callable[[Rows], object]]


class Unbatchable(PatternmillError):
    """A construct that has no form on whole batches; the reason is its message."""


def _divide(a, b):
    if np.any(np.asarray(b) == 0):
        raise RunError("division by zero")
    return a / b


def _modulo(a, b):
    if np.any(np.asarray(b) == 0):
        raise RunError("division by zero")
    if isinstance(b, float) and abs(b) < 1e300 and math.frexp(b)[0] in (0.5, -0.5):
        # By a power of two division, rounding and product are exact, and far faster than fmod.
        return a - np.trunc(a / b) * b
    return np.fmod(a, b)


_ARITHMETIC = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": _divide, "%": _modulo, "^": np.power}
_COMPARE = {"==": np.equal, "!=": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}


def _log(x):
    return np.where(np.asarray(x) == 0, -math.inf, np.log(np.where(np.asarray(x) < 0, math.nan, x)))


_FUNCTIONS = {"sin": np.sin, "cos": np.cos, "exp": np.exp, "log": _log, "sqrt": np.sqrt, "int": np.trunc}


def _wide(x, rows: Rows) -> np.ndarray:
    """A constant repeated for every row; anything else as it is."""
    return x if isinstance(x, np.ndarray) and x.ndim else np.broadcast_to(x, rows.shape)


def numbers_as_text(x: np.ndarray, fmt: str) -> pa.Array:
    """Numbers as the language writes them; whole ones by Arrow."""
    with np.errstate(invalid="ignore"):
        whole = (x == np.trunc(x)) & (np.abs(x) < 2.0**63)
    if whole.all():
        return pc.cast(pa.array(x.astype(np.int64)), pa.string())
    return pa.array([format_number(v, fmt) for v in x.tolist()], pa.string())


def _strings(own) -> pa.Array:
    return pa.array([x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in own], pa.string())


class Batched:
    """A program's rules as closures over the rows of one batch."""

    def __init__(self, program: S.Program, constants: dict, columns: list[str] | None, structured: bool, fs: str):
        """columns: the kinds (num, str or input) of a table's fields; None: records of text."""
        self.constants, self.columns, self.structured, self.fs = constants, columns, structured, fs
        self.variables = sorted({n.target.name for n in S.walk(program.rules) if isinstance(n, (S.Assign, S.Step)) and isinstance(n.target, S.Var)})
        if any(isinstance(n, (S.Assign, S.Step)) and (not isinstance(n.target, S.Var) or n.target.name == "NF") for n in S.walk(program.rules)):
            raise Unbatchable("a field or an element is assigned")
        #: Whether every piece is a line without its end.
        self.whole_lines = self.special("ORS") == "\n" and not any(isinstance(n, S.Print) and n.formatted for n in S.walk(program.rules))
        self.env: dict[str, np.ndarray] = {}
        self.fields: list = []
        self.out: list[tuple[Rows, list[pa.Array]]] = []
        self.frames: list[tuple[list, list]] = []
        self.rules = [self.rule(r) for r in program.rules]

    def special(self, name: str) -> str:
        return self.constants.get(name, {"OFS": " ", "ORS": "\n", "CONVFMT": "%.6g", "OFMT": "%.6g"}[name])

    # -- running

    def run(self, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
        """The batch's output in the order of its records: columns, or lines of text."""
        n = batch.num_rows
        self.env = {v: np.zeros(n) for v in self.variables}
        self.read(batch)
        self.out.clear()
        live = np.arange(n)
        with np.errstate(all="ignore"):
            for r in self.rules:
                live = r(live)
        width = len(names) if self.structured else 1
        if not self.out:
            return pa.RecordBatch.from_arrays([pa.array([], pa.string())] * width, names=names)
        # A record's own output was made in its order, which a stable sort keeps.
        order = pa.array(np.argsort(np.concatenate([r for r, _ in self.out]), kind="stable"))
        columns = []
        for i in range(width):
            parts = [own[i] if i < len(own) else pa.array([""] * len(rows), pa.string()) for rows, own in self.out]
            columns.append(pa.concat_arrays(parts).take(order))
        if not self.structured:
            columns = [self.lines_of(columns[0])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def lines_of(self, pieces: pa.Array) -> pa.Array:
        """Pieces of output as lines; a piece that print wrote is one, unless it holds a newline."""
        if self.whole_lines and not pc.any(pc.match_substring(pieces, "\n")).as_py():
            return pieces
        end = "\n" if self.whole_lines else ""
        lines = "".join(x + end for x in pieces.to_pylist()).split("\n")
        return pa.array(lines[:-1] if lines[-1] == "" else lines, pa.string())

    def read(self, batch: pa.RecordBatch) -> None:
        if self.columns is None:
            lines = [x or "" for x in batch.column(0).to_pylist()]
            self.lines = np.array(lines, object)
            pattern = regexes.python
            self.split = None if not lines else [split_fields(x, self.fs, pattern) for x in lines]
            return
        self.fields = []
        for kind, c in zip(self.columns, batch.columns, strict=True):
            if kind == "num":
                self.fields.append((c, c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)))
            else:
                self.fields.append((c, np.array([x or "" for x in c.to_pylist()], object)))

    # -- rules and statements

    def rule(self, r: S.Rule) -> Callable[[Rows], Rows]:
        if r.until is not None:
            raise Unbatchable("a range")
        body = self.statement(r.body if r.body is not None else S.Block((S.Print(()),)))
        test = self.test(r.pattern) if r.pattern is not None else None

        def run(rows: Rows) -> Rows:
            if test is None:
                return body(rows)
            holds = test(rows)
            return np.concatenate([rows[~holds], body(rows[holds])])

        return run

    def statement(self, s) -> Callable[[Rows], Rows]:
        """A function of the rows that reach the statement; it gives those that go on behind it."""
        if s is None:
            return lambda rows: rows
        if isinstance(s, S.Block):
            body = [self.statement(x) for x in s.body]

            def block(rows: Rows) -> Rows:
                for x in body:
                    if not len(rows):
                        break
                    rows = x(rows)
                return rows

            return block
        if isinstance(s, S.Expr):
            _, value = self.expr(s.value)

            def effect(rows: Rows) -> Rows:
                value(rows)
                return rows

            return effect
        if isinstance(s, S.Print):
            return self.output(s)
        if isinstance(s, S.If):
            test, yes, no = self.test(s.test), self.statement(s.yes), self.statement(s.no)

            def branch(rows: Rows) -> Rows:
                holds = test(rows)
                return np.concatenate([yes(rows[holds]), no(rows[~holds])])

            return branch
        if isinstance(s, S.While):
            return self.loop(self.test(s.test), self.statement(s.body), self.statement(None), s.at_end)
        if isinstance(s, S.For):
            init = self.statement(s.init)
            test = self.test(s.test) if s.test is not None else lambda rows: np.ones(len(rows), bool)
            run = self.loop(test, self.statement(s.body), self.statement(s.step), False)
            return lambda rows: run(init(rows))
        if isinstance(s, S.Jump) and s.kind in ("next", "break", "continue"):
            at = {"break": 0, "continue": 1}.get(s.kind)

            def jump(rows: Rows) -> Rows:
                if at is not None:
                    self.frames[-1][at].append(rows)
                return rows[:0]

            return jump
        raise Unbatchable(f"{type(s).__name__.lower()} in a rule")

    def loop(self, test, body, step, at_end: bool) -> Callable[[Rows], Rows]:
        def run(rows: Rows) -> Rows:
            done, asks = [rows[:0]], not at_end
            while len(rows):
                if asks:
                    holds = test(rows)
                    if not holds.all():
                        done.append(rows[~holds])
                        rows = rows[holds]
                        if not len(rows):
                            break
                asks = True
                self.frames.append(([], []))
                rows = body(rows)
                left, again = self.frames.pop()
                done += left
                rows = step(np.concatenate([rows, *again]) if again else rows)
            return np.concatenate(done)

        return run

    def output(self, s: S.Print) -> Callable[[Rows], Rows]:
        if s.to is not None:
            raise Unbatchable("output goes to a file or command")
        args = [self.printed(a) for a in s.args] if s.args else [self.printed(S.Field(S.Num(0.0)))]
        ofs, ors = self.special("OFS"), "" if self.whole_lines else self.special("ORS")
        if s.formatted:
            values = [self.expr(a) for a in s.args]

            def formatted(rows: Rows) -> Rows:
                given = [self.listed(v, rows) for v in values]
                self.out.append((rows, [_strings(sprintf(text(first), rest) for first, *rest in zip(*given, strict=True))]))
                return rows

            return formatted

        def plain(rows: Rows) -> Rows:
            if len(rows):
                given = [a(rows) for a in args]
                if not self.structured:
                    joined = pc.binary_join_element_wise(*given, ofs) if len(given) > 1 else given[0]
                    given = [pc.binary_join_element_wise(joined, ors, "") if ors else joined]
                self.out.append((rows, given))
            return rows

        return plain

    def printed(self, e) -> Callable[[Rows], pa.Array]:
        """What print writes for an expression; a table's field as it is stored."""
        e, fmt = S.strip(e), self.special("OFMT")
        if self.columns is not None and isinstance(e, S.Field) and isinstance(S.strip(e.index), S.Num):
            k = int(S.strip(e.index).value)
            if 0 < k <= len(self.columns) and self.columns[k - 1] == "num":

                def stored(rows: Rows) -> pa.Array:
                    column = self.fields[k - 1][0].take(pa.array(rows))
                    if pa.types.is_integer(column.type):
                        return pc.cast(column, pa.string()).fill_null("")
                    return pa.array(["" if v is None else format_number(float(v), fmt) for v in column.to_pylist()], pa.string())

                return stored
        kind, made = self.expr(e)
        if kind == "num":
            return lambda rows: numbers_as_text(_wide(made(rows), rows).astype(float), fmt)
        return lambda rows: _strings([""] * len(rows) if kind == "null" else _wide(np.asarray(made(rows), object), rows))

    def as_text(self, value: Value, fmt: str) -> Callable[[Rows], list[str]]:
        kind, made = value
        if kind == "num":
            return lambda rows: numbers_as_text(_wide(made(rows), rows).astype(float), fmt).to_pylist()
        return lambda rows: [""] * len(rows) if kind == "null" else _wide(np.asarray(made(rows), object), rows).tolist()

    def listed(self, value: Value, rows: Rows) -> list:
        kind, made = value
        if kind == "null":
            return [None] * len(rows)
        own = _wide(np.asarray(made(rows), float if kind == "num" else object), rows).tolist()
        return [Strnum(x) for x in own] if kind == "input" else own

    # -- expressions

    def number(self, e) -> Callable[[Rows], object]:
        kind, made = self.expr(e)
        if kind == "num":
            return made
        if kind == "null":
            return lambda rows: 0.0
        return lambda rows: np.array([num(x) for x in _wide(np.asarray(made(rows), object), rows)], float)

    def test(self, e) -> Callable[[Rows], np.ndarray]:
        kind, made = self.expr(e)
        if kind == "num":
            return lambda rows: _wide(made(rows), rows) != 0
        if kind == "str":
            return lambda rows: _wide(np.asarray(made(rows), object), rows) != ""
        return lambda rows: np.array([true(x) for x in self.listed((kind, made), rows)], bool)

    def expr(self, e) -> Value:
        e = S.strip(e)
        made = getattr(self, f"_{type(e).__name__.lower()}", None)
        if made is None:
            raise Unbatchable(f"{type(e).__name__.lower()} in a rule")
        return made(e)

    def _num(self, e: S.Num) -> Value:
        return "num", lambda rows: e.value

    def _str(self, e: S.Str) -> Value:
        return "str", lambda rows: e.value

    def _var(self, e: S.Var) -> Value:
        name = e.name
        if name in self.variables:
            return "num", lambda rows: self.env[name][rows]
        if name == "NF":
            if self.columns is not None:
                n = float(len(self.columns))
                return "num", lambda rows: n
            return "num", lambda rows: np.array([len(self.split[i]) for i in rows.tolist()], float)
        if name in ("NR", "FNR", "FILENAME"):
            raise Unbatchable(f"{name} in a rule")
        v = self.constants.get(name)
        if v is None:
            return "null", lambda rows: ""
        if isinstance(v, Strnum):
            raise Unbatchable(f"{name} is input")
        return ("num" if isinstance(v, float) else "str"), lambda rows: v

    def _field(self, e: S.Field) -> Value:
        index = S.strip(e.index)
        if self.columns is not None and index == S.Var("NF"):
            index = S.Num(float(len(self.columns)))
        if not isinstance(index, S.Num):
            raise Unbatchable("a computed field is read")
        k = int(index.value)
        if self.columns is None:
            if k == 0:
                return "input", lambda rows: self.lines[rows]
            return "input", lambda rows: np.array([own[k - 1] if k <= len(own) else "" for own in (self.split[i] for i in rows.tolist())], object)
        if not 0 < k <= len(self.columns):
            raise Unbatchable("the line of a table")
        return self.columns[k - 1], lambda rows: self.fields[k - 1][1][rows]

    def _unary(self, e: S.Unary) -> Value:
        if e.op == "!":
            test = self.test(e.operand)
            return "num", lambda rows: (~test(rows)).astype(float)
        value = self.number(e.operand)
        return "num", (lambda rows: np.negative(value(rows))) if e.op == "-" else value

    def _binary(self, e: S.Binary) -> Value:
        if e.op in ("&&", "||"):
            a, b, both = self.test(e.left), self.test(e.right), e.op == "&&"

            def logic(rows: Rows) -> np.ndarray:
                out = np.array(a(rows))
                rest = out if both else ~out
                out[rest] = b(rows[rest])
                return out.astype(float)

            return "num", logic
        if e.op == " ":
            fmt = self.special("CONVFMT")
            a, b = self.as_text(self.expr(e.left), fmt), self.as_text(self.expr(e.right), fmt)
            return "str", lambda rows: np.array([x + y for x, y in zip(a(rows), b(rows), strict=True)], object)
        if e.op in _COMPARE:
            (left, x), (right, y), holds = self.expr(e.left), self.expr(e.right), _COMPARE[e.op]
            if {left, right} == {"num"}:
                return "num", lambda rows: _wide(holds(x(rows), y(rows)), rows).astype(float)
            if "str" in (left, right):
                fmt = self.special("CONVFMT")
                a, b = self.as_text((left, x), fmt), self.as_text((right, y), fmt)
                encoded = lambda own: np.array([s.encode("utf-8", "surrogateescape") for s in own], object)
                return "num", lambda rows: holds(encoded(a(rows)), encoded(b(rows))).astype(float)
            holds = _HOLDS[e.op]
            return "num", lambda rows: np.array([holds(compare(a, b)) for a, b in zip(self.listed((left, x), rows), self.listed((right, y), rows), strict=True)], float)
        x, y, do = self.number(e.left), self.number(e.right), _ARITHMETIC[e.op]
        return "num", lambda rows: do(x(rows), y(rows))

    def _cond(self, e: S.Cond) -> Value:
        test, (left, yes), (right, no) = self.test(e.test), self.expr(e.yes), self.expr(e.no)
        if left != right:
            raise Unbatchable("a value's kind depends on the path")

        def choose(rows: Rows) -> np.ndarray:
            holds = test(rows)
            out = np.empty(len(rows), float if left == "num" else object)
            out[holds] = yes(rows[holds])
            out[~holds] = no(rows[~holds])
            return out

        return left, choose

    def _match(self, e: S.Match) -> Value:
        right = S.strip(e.right)
        if not isinstance(right, (S.Regex, S.Str)):
            raise Unbatchable("a computed pattern")
        pattern, value = regexes.python(right.source if isinstance(right, S.Regex) else right.value), self.as_text(self.expr(e.left), self.special("CONVFMT"))
        if pattern is None:
            raise Unbatchable("a pattern that is not well formed")
        return "num", lambda rows: np.array([(pattern.search(s) is not None) != e.negated for s in value(rows)], float)

    def _regex(self, e: S.Regex) -> Value:
        return self._match(S.Match(S.Field(S.Num(0.0)), e, False))

    def _assign(self, e: S.Assign) -> Value:
        name, value = e.target.name, self.expr(e.value) if e.op == "=" else None
        if value is None:
            given, do = self.number(e.value), _ARITHMETIC[e.op[0]]

            def augment(rows: Rows) -> np.ndarray:
                x = given(rows)
                v = do(self.env[name][rows], x)
                self.env[name][rows] = v
                return v

            return "num", augment
        if value[0] != "num":
            raise Unbatchable(f"{name} holds a string")

        def assign(rows: Rows) -> object:
            v = value[1](rows)
            self.env[name][rows] = v
            return v

        return "num", assign

    def _step(self, e: S.Step) -> Value:
        name, by = e.target.name, 1.0 if e.op == "++" else -1.0

        def step(rows: Rows) -> np.ndarray:
            old = self.env[name][rows]
            self.env[name][rows] = old + by
            return old + by if e.pre else old

        return "num", step

    def _builtin(self, e: S.Builtin) -> Value:
        if e.name in _FUNCTIONS:
            value, do = self.number(e.args[0]), _FUNCTIONS[e.name]
            return "num", lambda rows: do(value(rows))
        if e.name == "atan2":
            a, b = self.number(e.args[0]), self.number(e.args[1])
            return "num", lambda rows: np.arctan2(a(rows), b(rows))
        raise Unbatchable(f"{e.name} in a rule")
