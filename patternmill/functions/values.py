"""Values of the language in Python: numbers are float, strings str, input Strnum, nothing None."""

from __future__ import annotations

import math
import re


class Strnum(str):
    """A string from the input, which compares as a number if it looks like one."""

    __slots__ = ()


_BLANK = " \t\n\r\v\f"
_PREFIX = re.compile(
    r"[ \t\n\r\v\f]*(?:(?P<hex>[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?)"
    r"|(?P<dec>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<sign>[+-]?)(?P<word>[nN][aA][nN]|[iI][nN][fF]))"
)
_WHOLE = re.compile(
    r"(?P<hex>[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?)"
    r"|(?P<dec>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<sign>[+-]?)(?P<word>[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)"
)


def _parsed(m: re.Match) -> float:
    if m["dec"]:
        return float(m["dec"])
    if m["hex"]:
        return float.fromhex(m["hex"])
    sign = -1.0 if m["sign"] == "-" else 1.0
    return math.nan if m["word"][0] in "nN" else sign * math.inf


def number_prefix(text: str) -> float:
    """The number that a string starts with, or 0."""
    m = _PREFIX.match(text)
    return _parsed(m) if m else 0.0


def looks_numeric(text: str) -> float | None:
    """The number that a string as a whole is, blanks around it aside; the empty string is 0."""
    text = text.strip(_BLANK)
    if not text:
        return 0.0
    m = _WHOLE.fullmatch(text)
    if not m:
        return None
    out = _parsed(m)
    return None if math.isinf(out) and not m["word"] else out


def num(v) -> float:
    return v if type(v) is float else 0.0 if v is None else number_prefix(v)


def format_number(x: float, fmt: str = "%.6g") -> str:
    if x != x:
        return "nan"
    if x in (math.inf, -math.inf):
        return "inf" if x > 0 else "-inf"
    if x == math.trunc(x) and -(2.0**63) <= x < 2.0**63:
        return str(int(x))
    return fmt % x if fmt == "%.6g" else sprintf(fmt, [x])


def text(v, fmt: str = "%.6g") -> str:
    return format_number(v, fmt) if type(v) is float else "" if v is None else v


def true(v) -> bool:
    if type(v) is float:
        return v != 0
    if type(v) is Strnum:
        n = looks_numeric(v)
        return n != 0 if n is not None else v != ""
    return bool(v)


def compare(a, b) -> int | None:
    """-1, 0 or 1; None if one side is not a number (nan), which no comparison but != holds for."""
    x = a if type(a) is float else 0.0 if a is None else looks_numeric(a) if type(a) is Strnum else None
    y = b if type(b) is float else 0.0 if b is None else looks_numeric(b) if type(b) is Strnum else None
    if x is None or y is None:
        s, t = text(a).encode("utf-8", "surrogateescape"), text(b).encode("utf-8", "surrogateescape")
        return (s > t) - (s < t)
    return None if x != x or y != y else (x > y) - (x < y)


def substr(s: str, m: float, n: float | None = None) -> str:
    """Positions count bytes. A start before 1 is moved to 1 without shortening the piece."""
    m = max(1, _whole(m))
    size = None if n is None else _whole(n)
    if size is not None and size <= 0:
        return ""
    if s.isascii():
        return s[m - 1 :] if size is None else s[m - 1 : m - 1 + size]
    b = s.encode("utf-8", "surrogateescape")
    return (b[m - 1 :] if size is None else b[m - 1 : m - 1 + size]).decode("utf-8", "surrogateescape")


def _whole(x: float) -> int:
    return 0 if x != x else (1 << 62) * (1 if x > 0 else -1) if math.isinf(x) else int(x)


def byte_length(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogateescape"))


def index(s: str, t: str) -> int:
    at = s.find(t)
    return 0 if at < 0 else byte_length(s[:at]) + 1


_SPEC = re.compile(r"%([-+ #0]*)(\*|[0-9]+)?(?:\.(\*|[0-9]*))?(.)", re.S)


def sprintf(fmt: str, args: list) -> str:
    """C's formats; missing arguments are nothing, further ones are ignored, unknown letters are echoed."""
    given = iter(args)

    def one(m: re.Match) -> str:
        flags, width, digits, kind = m[1], m[2] or "", m[3], m[4]
        if kind == "%":
            return "%"
        if width == "*":
            n = int(num(next(given, None)))
            flags, width = (flags + "-", str(-n)) if n < 0 else (flags, str(n))
        if digits == "*":
            digits = str(max(0, int(num(next(given, None)))))
        if kind not in "dioxXucseEfFgG":
            return m[0]
        v = next(given, None)
        spec = f"%{flags}{width}" + ("" if digits is None else f".{digits or 0}")
        if kind == "c":
            if type(v) is float:
                return chr(int(v)) if 0 <= v < 256 else ""
            return text(v)[:1]
        if kind == "s":
            return f"%{flags.replace('0', '')}{width}{'' if digits is None else f'.{digits or 0}'}s" % text(v)
        x = num(v)
        if kind in "dioxXu":
            if x != x or math.isinf(x):
                return f"%{flags.replace('0', '')}{width}s" % text(x)
            n = max(-(1 << 63), min((1 << 63) - 1, int(x)))
            if kind in "oxXu" and n < 0:
                n += 1 << 64
            if kind == "o" and "#" in flags:
                return f"%{flags.replace('#', '')}{width}s" % f"0{n:o}"
            return f"{spec}{'d' if kind in 'iu' else kind}" % n
        if kind in "gG" and digits is None and not flags and not width:
            shortest = repr(x)
            return shortest[:-2] if shortest.endswith(".0") else shortest
        return f"{spec}{kind}" % x

    return _SPEC.sub(one, fmt)


def replacement(template: str) -> list[str | None]:
    r"""The parts of sub's replacement; None stands for the match. \& is an ampersand, \\ a backslash."""
    out: list[str | None] = []
    piece = ""
    i = 0
    while i < len(template):
        c = template[i]
        if c == "\\" and i + 1 < len(template) and template[i + 1] in "&\\":
            piece += template[i + 1]
            i += 2
            continue
        if c == "&":
            out += [piece, None]
            piece = ""
        else:
            piece += c
        i += 1
    return [*out, piece]


def substitute(pattern: re.Pattern, template: str, s: str, every: bool) -> tuple[int, str]:
    parts = replacement(template)

    def one(m: re.Match) -> str:
        return "".join(m[0] if p is None else p for p in parts)

    out, n = pattern.subn(one, s, 0 if every else 1)
    return n, out


def split_fields(s: str, fs: str, pattern) -> list[str]:
    """Fields of a record: pattern(fs) gives the compiled form of a longer separator."""
    if not s:
        return []
    if fs == " ":
        return [x for x in re.split("[ \t\n\r\v\f]+", s) if x]
    if fs == "":
        return []
    return s.split(fs) if len(fs) == 1 and fs != "\\" else pattern(fs).split(s)
