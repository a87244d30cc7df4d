"""Values of the language as Spark columns of a kind known at planning time.

Kinds: num (a numeric column), str, strnum (a string from the input, which compares as a
number if it looks like one; null where the field is missing) and null (never assigned).
Everything here stays in whole-stage code generation, except where C's rounding is asked
for (%e %f %g and CONVFMT), which is an Arrow UDF.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regexes
from .values import format_number, replacement, sprintf

_BLANK = r"[ \t\n\r\x0b\f]*"
_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_HEX = r"[+-]?0[xX][0-9a-fA-F]+"


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str
    whole: bool = False  # a num of an integer type
    ascii: bool = False  # a str without other than ASCII characters
    nullable: bool = False  # a num that is null where nothing was assigned yet
    deps: frozenset = frozenset()  # carried variables that the column reads

    def on(self, *others: Val) -> Val:
        return replace(self, deps=self.deps.union(*[o.deps for o in others]))


def number(x: float) -> Val:
    return Val(F.lit(float(x)), "num")


def string(x: str) -> Val:
    return Val(F.lit(x), "str", ascii=x.isascii())


def nothing() -> Val:
    return Val(F.lit(None).cast("string"), "null")


def looks_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"\A{_BLANK}(?:{_DECIMAL}|{_HEX}|[+-]?(?i:nan|inf|infinity))?{_BLANK}\z"), F.lit(False))


def _simple(c: Column) -> Column:
    """Whether a string is a plain decimal number, which a cast reads as the language does."""
    return c.rlike(r"\A[+-]?[0-9]{1,300}(?:\.[0-9]{0,300})?\z")


def parsed(c: Column) -> Column:
    """The number that a string starts with, or 0."""
    return F.when(_simple(c), c.try_cast("double")).otherwise(_parsed(c))


def _parsed(c: Column) -> Column:
    plain = F.regexp_substr(c, F.lit(rf"\A{_BLANK}{_DECIMAL}"))
    value = F.coalesce(F.trim(F.translate(plain, "\t\n\r\x0b\f", "     ")).try_cast("double"), F.lit(0.0))
    digits = F.regexp_extract(c, rf"\A{_BLANK}([+-]?)0[xX]([0-9a-fA-F]+)", 2)
    sign = F.when(c.rlike(rf"\A{_BLANK}-"), -1.0).otherwise(1.0)
    word = F.lower(F.regexp_extract(c, rf"\A{_BLANK}[+-]?((?i:nan|inf))", 1))
    return (
        F.when(c.isNull(), 0.0)
        .when(c.rlike(rf"\A{_BLANK}{_HEX}"), sign * F.conv(digits, 16, 10).cast("double"))
        .when(word == "nan", float("nan"))
        .when(word == "inf", sign * float("inf"))
        .otherwise(value)
    )


def num(v: Val) -> Column:
    if v.kind == "num":
        return F.coalesce(v.col.cast("double"), F.lit(0.0)) if v.nullable else v.col.cast("double")
    return F.lit(0.0) if v.kind == "null" else parsed(v.col)


def _formatter(fmt: str):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda n: None if n is None else format_number(float(n), fmt))

    return run


def text(v: Val, fmt: str = "%.6g") -> Column:
    if v.kind == "null":
        return F.lit("")
    if v.kind in ("str", "strnum"):
        return F.coalesce(v.col, F.lit(""))
    if v.whole:
        return F.coalesce(v.col.cast("string"), F.lit(""))
    x = v.col.cast("double")
    whole = (x == F.rint(x)) & (F.abs(x) < 9.2e18)
    return F.when(x.isNull(), "").when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(_formatter(fmt)(x))


def boolean(v: Val) -> Column:
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "num":
        return num(v) != 0
    filled = F.coalesce(v.col, F.lit(""))
    if v.kind == "str":
        return filled != ""
    return F.when(_simple(v.col), v.col.try_cast("double") != 0).when(looks_numeric(v.col), _parsed(v.col) != 0).otherwise(filled != "")


def flag(c: Column) -> Val:
    """A truth value as 1 or 0; the column itself is kept for conditions."""
    return Truth(F.when(c, 1.0).otherwise(0.0), "num", test=c)


@dataclass(frozen=True)
class Truth(Val):
    test: Column | None = None


def holds(v: Val) -> Column:
    return v.test if isinstance(v, Truth) and v.test is not None else boolean(v)


_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _as_number(v: Val) -> Column:
    """A number as it is stored, so that comparisons of typed columns reach the scan."""
    return F.lit(0.0) if v.kind == "null" else (num(v) if v.nullable else v.col) if v.kind == "num" else parsed(v.col)


def compared(op: str, a: Val, b: Val) -> Val:
    do = _OPS[op]
    if a.kind in ("num", "null") and b.kind in ("num", "null"):
        return flag(do(_as_number(a), _as_number(b))).on(a, b)
    strings = do(text(a), text(b))
    if a.kind == "str" or b.kind == "str":
        # An input string against a constant: no coalesce, so the scan can filter.
        if a.kind in ("str", "strnum") and b.kind in ("str", "strnum") and op != "!=":
            strings = do(a.col, b.col) if op in ("==", ">") else strings
        return flag(strings).on(a, b)
    inputs = [v.col for v in (a, b) if v.kind == "strnum"]
    simple, numeric = ([f(c) for c in inputs] for f in (_simple, looks_numeric))
    if len(inputs) == 2:
        simple, numeric = [simple[0] & simple[1]], [numeric[0] & numeric[1]]
    # Plain numbers first, as nearly all input is; the other forms cost several patterns.
    x, y = (v.col.try_cast("double") if v.kind == "strnum" else _as_number(v) for v in (a, b))
    return flag(F.when(simple[0], do(x, y)).when(numeric[0], do(_as_number(a), _as_number(b))).otherwise(strings)).on(a, b)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    x, y = num(a), num(b)
    if op == "/":
        out = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_divide(x, y))
    elif op == "%":
        out = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_mod(x, y))
    elif op == "^":
        out = F.pow(x, y)
    else:
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
    return Val(out, "num").on(a, b)


def concat(a: Val, b: Val, fmt: str) -> Val:
    return Val(F.concat(text(a, fmt), text(b, fmt)), "str", ascii=a.ascii and b.ascii).on(a, b)


def matches(v: Val, source: str, fmt: str = "%.6g") -> Column:
    """Whether a literal pattern matches; a pattern without operators becomes contains."""
    own = text(v, fmt)
    if (plain := regexes.literal(source)) is not None:
        return own.contains(plain)
    if source[:1] == "^" and regexes.literal(source[1:]) is not None:
        return own.startswith(source[1:])
    if source[-1:] == "$" and regexes.literal(source[:-1]) is not None:
        return own.endswith(source[:-1])
    try:
        return own.rlike(regexes.translate(source))
    except ValueError:
        return F.lit(False)


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("double")


def position(c: Column, part: Column) -> Column:
    """1-based byte position of the first occurrence, or 0."""
    at = F.instr(c, part) if not isinstance(part, str) else F.instr(c, part)
    return F.when(at == 0, 0.0).otherwise(F.octet_length(F.substring(c, F.lit(1), at - 1)).cast("double") + 1)


def substr(s: Column, m: Column, n: Column | None) -> Column:
    """Bytes from m on, n of them; a start before 1 counts as 1."""
    start = F.greatest(F.lit(1), F.least(m, F.lit(2e9)).cast("int"))
    size = F.lit(2_000_000_000) if n is None else F.least(n, F.lit(2e9)).cast("int")
    piece = F.substring(s.cast("binary"), start, size).cast("string")
    return piece if n is None else F.when(size <= 0, "").otherwise(piece)


def replaced(s: Column, source: str, template: str, every: bool) -> tuple[Column, Column]:
    """How often a pattern matches (once at most unless every), and the string with its matches replaced."""
    pattern = regexes.translate(source)
    java = "".join("$0" if p is None else p.replace("\\", "\\\\").replace("$", "\\$") for p in replacement(template))
    count = F.regexp_count(s, F.lit(pattern)).cast("double")
    if every:
        return count, F.regexp_replace(s, pattern, java)
    # The first match only: its text is replaced where it begins.
    found = F.regexp_substr(s, F.lit(pattern))
    at = F.regexp_instr(s, F.lit(pattern))
    piece = F.concat(*[found if p is None else F.lit(p) for p in replacement(template)])
    once = F.concat(F.substring(s, F.lit(1), at - 1), piece, F.substring(s, at + F.length(found), F.length(s)))
    return F.least(count, F.lit(1.0)), F.when(found.isNull(), s).otherwise(once)


def formatted(fmt: str, args: list[Val]) -> Column:
    """sprintf with a constant format: Java's format for %d, %s and %%, C's by an Arrow UDF for the rest."""
    import re

    specs = re.findall(r"%[-+ #0]*[0-9]*(?:\.[0-9]*)?.", fmt)
    simple = all(s == "%%" or re.fullmatch(r"%-?[0-9]*[ds]", s) or re.fullmatch(r"%0[0-9]+d", s) for s in specs)
    wanted = [s[-1] for s in specs if s != "%%"]
    if simple and len(wanted) <= len(args):
        given = [F.least(F.greatest(num(a), F.lit(-9.2e18)), F.lit(9.2e18)).cast("long") if k == "d" else text(a) for k, a in zip(wanted, args, strict=False)]
        java = re.sub(r"%(-?)0([ds])", r"%\1\2", fmt)
        return F.format_string(java, *given)
    if not args:
        return F.lit(sprintf(fmt, []))
    kinds = [a.kind for a in args]

    @F.pandas_udf("string")
    def run(x: pd.DataFrame) -> pd.Series:
        rows = zip(*[x[c].tolist() for c in x.columns], strict=True)
        return pd.Series([sprintf(fmt, [float(v) if k == "num" and v is not None else v for k, v in zip(kinds, row, strict=True)]) for row in rows], dtype=object)

    return run(F.struct(*[(num(a) if a.kind == "num" else text(a)).alias(f"a{i}") for i, a in enumerate(args)]))


def logarithm(x: Column) -> Column:
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


def truncated(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) >= 4.5e15), x).when(x < 0, F.ceil(x).cast("double")).otherwise(F.floor(x).cast("double"))
