"""Extended regular expressions, translated for Java (Spark) and for Python.

Both engines take the leftmost match but the first alternative; alternations of plain words
are therefore put longest first, which makes them take the longest as well.
"""

from __future__ import annotations

import re
from functools import lru_cache

_CLASSES = {
    "alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": " \\t\\n\\r\\f\\x0b", "blank": " \\t",
    "punct": "!-/:-@\\[-`{-~", "print": " -~", "graph": "!-~", "cntrl": "\\x00-\\x1f\\x7f", "xdigit": "0-9A-Fa-f",
}
_PLAIN = set("\"'/ ,;:=<>!@#%&_-~`")


def _bracket(source: str, at: int) -> tuple[str, int]:
    """A bracket expression's translation and where it ends; the text is after the opening bracket."""
    out, i = "[", at
    if source[i : i + 1] == "^":
        out, i = "[^", i + 1
    first = True
    while i < len(source) and (first or source[i] != "]"):
        if m := re.compile(r"\[:(\w+):\]").match(source, i):
            if m[1] not in _CLASSES:
                raise ValueError(f"unknown character class {m[1]}")
            out += _CLASSES[m[1]]
            i = m.end()
        elif source[i] == "\\" and i + 1 < len(source):
            c = source[i + 1]
            out += {"n": "\\n", "t": "\\t", "r": "\\r", "f": "\\f", "v": "\\x0b", "/": "/", '"': '"', "d": "0-9", "s": " \\t\\n\\r\\f\\x0b", "w": "a-zA-Z0-9_"}.get(c, "\\" + c if not c.isalnum() else c)
            i += 2
        else:
            c = source[i]
            out += "\\" + c if c in "[]&~|^" and not (c == "^" and False) else c
            i += 1
        first = False
    if i >= len(source):
        raise ValueError("bracket without end")
    return out + "]", i + 1


def _longest_first(body: str) -> str:
    parts = body.split("|")
    plain = all(p and all(c.isalnum() or c in _PLAIN for c in p) for p in parts)
    return "|".join(sorted(parts, key=len, reverse=True)) if plain and len(parts) > 1 else body


@lru_cache(1000)
def translate(source: str) -> str:
    """A pattern that both Java and Python read; raises ValueError where there is none."""
    out, i, depth = [""], 0, 0
    while i < len(source):
        c = source[i]
        if c == "[":
            piece, i = _bracket(source, i + 1)
            out[-1] += piece
            continue
        if c == "\\" and i + 1 < len(source):
            e = source[i + 1]
            known = {"n": "\\n", "t": "\\t", "r": "\\r", "f": "\\f", "v": "\\x0b", "a": "\\x07", "b": "\\b", "B": "\\B", "d": "[0-9]", "D": "[^0-9]", "s": "[ \\t\\n\\r\\f\\x0b]", "S": "[^ \\t\\n\\r\\f\\x0b]", "w": "[a-zA-Z0-9_]", "W": "[^a-zA-Z0-9_]", "y": "\\b"}
            out[-1] += known.get(e, e if e.isalnum() or e == " " else re.escape(e))
            i += 2
            continue
        if c == "(":
            out.append("")
        elif c == ")":
            if len(out) == 1:
                raise ValueError("unmatched )")
            body = _longest_first(out.pop())
            out[-1] += f"(?:{body})"
        elif c == "^":
            out[-1] += "\\A" if not out[-1] or out[-1][-1] == "|" else "\\^" if out[-1] else "\\A"
        elif c == "$":
            out[-1] += "(?!.|\\n)" if i + 1 == len(source) or source[i + 1] in ")|" else "\\$"
        elif c == "{" and not re.compile(r"\{[0-9]*(,[0-9]*)?\}").match(source, i):
            out[-1] += "\\{"
        elif c == "}" and not re.search(r"\{[0-9]*(,[0-9]*)?$", out[-1]):
            out[-1] += "\\}"
        elif c in "*+?" and (not out[-1] or out[-1][-1] == "|"):
            out[-1] += "\\" + c
        else:
            out[-1] += c
        i += 1
    if len(out) > 1:
        raise ValueError("unmatched (")
    return "(?s)" + _longest_first(out[0])


@lru_cache(1000)
def python(source: str) -> re.Pattern | None:
    """The compiled pattern; None for one that is not well formed, which matches nothing."""
    try:
        return re.compile(translate(source))
    except (ValueError, re.error):
        return None


def literal(source: str) -> str | None:
    """The text that a pattern without operators stands for."""
    return source if source and all(c.isalnum() or c in _PLAIN for c in source) else None
