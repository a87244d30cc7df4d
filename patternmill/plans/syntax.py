"""Syntax trees of pattern-action programs, and the lexer and parser that make them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from ..errors import ParseError


@dataclass(frozen=True)
class Node:
    pass


# ---- expressions


@dataclass(frozen=True)
class Num(Node):
    value: float


@dataclass(frozen=True)
class Str(Node):
    value: str


@dataclass(frozen=True)
class Regex(Node):
    source: str


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Index(Node):
    array: str
    keys: tuple[Node, ...]


@dataclass(frozen=True)
class Field(Node):
    index: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    """Arithmetic, comparison, && and ||, and concatenation (op ' ')."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Match(Node):
    left: Node
    right: Node
    negated: bool


@dataclass(frozen=True)
class In(Node):
    keys: tuple[Node, ...]
    array: str


@dataclass(frozen=True)
class Cond(Node):
    test: Node
    yes: Node
    no: Node


@dataclass(frozen=True)
class Assign(Node):
    op: str
    target: Node
    value: Node


@dataclass(frozen=True)
class Step(Node):
    """++ and --, before (pre) or after the target."""

    op: str
    target: Node
    pre: bool


@dataclass(frozen=True)
class Call(Node):
    """A call of a user's function."""

    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Builtin(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Group(Node):
    """Parentheses: one expression, or several as in print (a, b)."""

    items: tuple[Node, ...]


@dataclass(frozen=True)
class Getline(Node):
    """source: None for the main input, else an expression; how: '', '<' or '|'."""

    target: Node | None
    source: Node | None
    how: str


# ---- statements


@dataclass(frozen=True)
class Block(Node):
    body: tuple[Node, ...]


@dataclass(frozen=True)
class Expr(Node):
    value: Node


@dataclass(frozen=True)
class Print(Node):
    """print and printf; how is '', '>', '>>' or '|' and says where to."""

    args: tuple[Node, ...]
    formatted: bool = False
    how: str = ""
    to: Node | None = None


@dataclass(frozen=True)
class If(Node):
    test: Node
    yes: Node
    no: Node | None


@dataclass(frozen=True)
class While(Node):
    test: Node
    body: Node
    at_end: bool = False  # do ... while


@dataclass(frozen=True)
class For(Node):
    init: Node | None
    test: Node | None
    step: Node | None
    body: Node


@dataclass(frozen=True)
class ForIn(Node):
    name: str
    array: str
    body: Node


@dataclass(frozen=True)
class Delete(Node):
    array: str
    keys: tuple[Node, ...] | None


@dataclass(frozen=True)
class Jump(Node):
    """next, nextfile, break or continue."""

    kind: str


@dataclass(frozen=True)
class Exit(Node):
    code: Node | None


@dataclass(frozen=True)
class Return(Node):
    value: Node | None


# ---- programs


@dataclass(frozen=True)
class Rule(Node):
    """No pattern: every record. until: the second pattern of a range. No body: print the record."""

    pattern: Node | None
    until: Node | None
    body: Block | None


@dataclass(frozen=True)
class Function(Node):
    name: str
    params: tuple[str, ...]
    body: Block


@dataclass(frozen=True)
class Program(Node):
    begin: tuple[Block, ...] = ()
    rules: tuple[Rule, ...] = ()
    end: tuple[Block, ...] = ()
    functions: dict[str, Function] = field(default_factory=dict)
    source: str = ""


def walk(node: Any):
    """A node and all below it, depth first."""
    if isinstance(node, (tuple, list)):
        for x in node:
            yield from walk(x)
    elif isinstance(node, dict):
        yield from walk(list(node.values()))
    elif is_dataclass(node):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))


# ---- lexer

KEYWORDS = frozenset("BEGIN END function func if else while do for in break continue next nextfile exit return delete print printf getline".split())
#: Least and greatest number of arguments.
BUILTINS = {
    "atan2": (2, 2), "close": (1, 1), "cos": (1, 1), "exp": (1, 1), "fflush": (0, 1), "gsub": (2, 3), "index": (2, 2), "int": (1, 1),
    "length": (0, 1), "log": (1, 1), "match": (2, 2), "rand": (0, 0), "sin": (1, 1), "split": (2, 3), "sprintf": (1, None), "sqrt": (1, 1),
    "srand": (0, 1), "sub": (2, 3), "substr": (2, 3), "system": (1, 1), "tolower": (1, 1), "toupper": (1, 1),
}
_SCAN = re.compile(
    r"(?P<blank>(?:[ \t\r]|\\\r?\n|#[^\n]*)+)|(?P<newline>\n)"
    r"|(?P<number>0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<op>&&|\|\||\+\+|--|[-+*/%^]=|[<>=!]=|>>|!~|[-+*/%^!<>|?:~$=,;(){}\[\]])"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "\\": "\\", '"': '"', "'": "'", "/": "/"}
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|x([0-9a-fA-F]{1,2})|(.)|$)", re.S)


def unescape(text: str) -> str:
    """A string literal's value."""

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            byte = int(m[1], 8) & 255 if m[1] else int(m[2], 16)
            return chr(byte if byte < 128 else 0xDC00 + byte)
        return _ESCAPES.get(m[3], m[3]) if m[3] else "\\"

    # A byte over 127 stands as a surrogate unless it is part of a character.
    return _ESCAPE.sub(one, text).encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")


@dataclass
class Token:
    kind: str  # number, string, regex, name, function, builtin, keyword, op, newline or end
    text: str
    at: int


def lex(source: str) -> list[Token]:
    out: list[Token] = []
    at = 0

    def fail(message: str) -> ParseError:
        line = source.count("\n", 0, at) + 1
        return ParseError(message, line, at - source.rfind("\n", 0, at))

    while at < len(source):
        c = source[at]
        last = out[-1] if out else None
        if c in "\"'":
            end = at + 1
            while end < len(source) and source[end] != c:
                end += 2 if source[end] == "\\" else 1
                if source[end - 1 : end] == "\n" and source[end - 2 : end - 1] != "\\":
                    raise fail("newline in string")
            if end >= len(source):
                raise fail("string without end")
            out.append(Token("string", unescape(source[at + 1 : end].replace("\\\n", "")), at))
            at = end + 1
            continue
        divides = last is not None and (last.kind in ("number", "string", "regex", "name", "builtin") or last.text in (")", "]", "$", "++", "--"))
        if c == "/" and not divides:
            end, bracket = at + 1, False
            while end < len(source) and (source[end] != "/" or bracket):
                if source[end] == "\n":
                    raise fail("newline in regular expression")
                if source[end] == "\\":
                    end += 1
                elif source[end] == "[" and not bracket:
                    bracket = True
                    if source[end + 1 : end + 2] == "^":
                        end += 1
                    if source[end + 1 : end + 2] == "]":
                        end += 1
                elif source[end] == "]":
                    bracket = False
                end += 1
            if end >= len(source):
                raise fail("regular expression without end")
            out.append(Token("regex", source[at + 1 : end].replace("\\/", "/"), at))
            at = end + 1
            continue
        m = _SCAN.match(source, at)
        if not m:
            raise fail(f"unexpected {c!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "name":
            kind = "keyword" if text in KEYWORDS else "builtin" if text in BUILTINS else "function" if source[m.end() : m.end() + 1] == "(" else "name"
        if kind != "blank":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "end of program", at))
    return out


# ---- parser

_LEVELS: list[tuple[str, ...]] = [("+", "-"), ("*", "/", "%")]


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, lex(source), 0
        self.no_in = self.no_gt = False
        self.in_function = self.in_loop = 0
        self.in_rule = False

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str) -> ParseError:
        at = self.now.at
        return ParseError(message, self.source.count("\n", 0, at) + 1, at - self.source.rfind("\n", 0, at))

    def sees(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind in ("op", "keyword", "newline")

    def takes(self, *texts: str) -> str | None:
        if self.sees(*texts):
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def must(self, text: str) -> None:
        if not self.takes(text):
            raise self.fail(f"expected {text!r} instead of {self.now.text!r}")

    def name(self) -> str:
        if self.now.kind not in ("name", "function"):
            raise self.fail(f"expected a name instead of {self.now.text!r}")
        self.at += 1
        return self.tokens[self.at - 1].text

    def lines(self) -> None:
        while self.now.kind == "newline":
            self.at += 1

    def ends(self) -> None:
        """Line ends and semicolons."""
        while self.now.kind == "newline" or self.sees(";"):
            self.at += 1

    # -- programs

    def program(self) -> Program:
        begin, rules, end, functions = [], [], [], {}
        self.ends()
        while self.now.kind != "end":
            if self.takes("function", "func"):
                f = self.function()
                if f.name in functions:
                    raise self.fail(f"function {f.name} is defined twice")
                functions[f.name] = f
            elif self.takes("BEGIN"):
                begin.append(self.action("BEGIN"))
            elif self.takes("END"):
                end.append(self.action("END"))
            else:
                self.in_rule = True
                pattern = until = body = None
                if not self.sees("{"):
                    pattern = self.expr()
                    if self.takes(","):
                        self.lines()
                        until = self.expr()
                if self.sees("{"):
                    body = self.block()
                rules.append(Rule(pattern, until, body))
                self.in_rule = False
            if self.now.kind != "end" and not (self.now.kind == "newline" or self.sees(";")) and self.tokens[self.at - 1].text != "}":
                raise self.fail(f"unexpected {self.now.text!r}")
            self.ends()
        return Program(tuple(begin), tuple(rules), tuple(end), functions, self.source)

    def action(self, what: str) -> Block:
        if not self.sees("{"):
            raise self.fail(f"{what} needs an action")
        return self.block()

    def function(self) -> Function:
        name = self.name()
        self.must("(")
        params: list[str] = []
        self.lines()
        while not self.takes(")"):
            params.append(self.name())
            if params[-1] == name or params[-1] in params[:-1]:
                raise self.fail(f"parameter {params[-1]} has a name that is taken")
            self.lines()
            if not self.sees(")"):
                self.must(",")
                self.lines()
        self.lines()
        self.in_function += 1
        body = self.block()
        self.in_function -= 1
        return Function(name, tuple(params), body)

    # -- statements

    def block(self) -> Block:
        self.must("{")
        body = []
        self.ends()
        while not self.takes("}"):
            if self.now.kind == "end":
                raise self.fail("expected '}'")
            body.append(self.statement())
            self.ends()
        return Block(tuple(body))

    def ended(self, statement: Node) -> Node:
        if not (self.takes(";") or self.now.kind in ("newline", "end") or self.sees("}")):
            raise self.fail(f"unexpected {self.now.text!r}")
        return statement

    def body(self) -> Node:
        self.lines()
        if self.takes(";"):
            return Block(())
        return self.statement()

    def looped(self) -> Node:
        self.in_loop += 1
        out = self.body()
        self.in_loop -= 1
        return out

    def statement(self) -> Node:
        if self.sees("{"):
            return self.block()
        if self.takes("if"):
            self.must("(")
            test = self.expr()
            self.must(")")
            yes = self.body()
            mark = self.at
            self.ends()
            if self.takes("else"):
                return If(test, yes, self.body())
            self.at = mark
            return If(test, yes, None)
        if self.takes("while"):
            self.must("(")
            test = self.expr()
            self.must(")")
            return While(test, self.looped())
        if self.takes("do"):
            body = self.looped()
            self.ends()
            self.must("while")
            self.must("(")
            test = self.expr()
            self.must(")")
            return self.ended(While(test, body, True))
        if self.takes("for"):
            return self.loop()
        return self.ended(self.simple())

    def loop(self) -> Node:
        self.must("(")
        t = self.tokens[self.at : self.at + 4]
        if [x.kind for x in t[:3]] == ["name", "keyword", "name"] and t[1].text == "in" and t[3].text == ")":
            self.at += 4
            return ForIn(t[0].text, t[2].text, self.looped())
        init = None if self.sees(";") else self.simple()
        self.must(";")
        self.lines()
        test = None if self.sees(";") else self.expr()
        self.must(";")
        self.lines()
        step = None if self.sees(")") else self.simple()
        self.must(")")
        return For(init, test, step, self.looped())

    def simple(self) -> Node:
        if word := self.takes("print", "printf"):
            return self.output(word == "printf")
        if word := self.takes("next", "nextfile"):
            if not self.in_rule and not self.in_function:
                raise self.fail(f"{word} outside a rule")
            return Jump(word)
        if word := self.takes("break", "continue"):
            if not self.in_loop:
                raise self.fail(f"{word} outside a loop")
            return Jump(word)
        if self.takes("exit"):
            return Exit(None if self.finished() else self.expr())
        if self.takes("return"):
            if not self.in_function:
                raise self.fail("return outside a function")
            return Return(None if self.finished() else self.expr())
        if self.takes("delete"):
            name = self.name()
            keys = None
            if self.takes("["):
                keys = self.subscripts()
            return Delete(name, keys)
        return Expr(self.expr())

    def finished(self) -> bool:
        return self.now.kind in ("newline", "end") or self.sees(";", "}")

    def output(self, formatted: bool) -> Node:
        args: tuple[Node, ...] = ()
        if not self.finished() and not self.sees(">", ">>", "|"):
            before, self.no_gt = self.no_gt, True
            items = [self.expr()]
            while self.takes(","):
                self.lines()
                items.append(self.expr())
            self.no_gt = before
            # print (a, b) prints two things; parentheses around one are ordinary.
            args = items[0].items if len(items) == 1 and isinstance(items[0], Group) and len(items[0].items) > 1 else tuple(items)
        if formatted and not args:
            raise self.fail("printf needs a format")
        if how := self.takes(">", ">>", "|"):
            return Print(args, formatted, how, self.concat(no_gt=True))
        return Print(args, formatted)

    # -- expressions, loosest first

    def expr(self) -> Node:
        left = self.ternary()
        if self.sees("=", "+=", "-=", "*=", "/=", "%=", "^="):
            target = left.items[0] if isinstance(left, Group) and len(left.items) == 1 else left
            if not isinstance(target, (Var, Field, Index)):
                raise self.fail("assignment to something that cannot be assigned")
            op = self.takes("=", "+=", "-=", "*=", "/=", "%=", "^=")
            self.lines()
            return Assign(op, target, self.expr())
        return left

    def ternary(self) -> Node:
        test = self.either()
        if self.takes("?"):
            self.lines()
            yes = self.assigned()
            self.lines()
            self.must(":")
            self.lines()
            return Cond(test, yes, self.assigned())
        return test

    def assigned(self) -> Node:
        return self.expr()

    def either(self) -> Node:
        left = self.both()
        while self.takes("||"):
            self.lines()
            left = Binary("||", left, self.both())
        return left

    def both(self) -> Node:
        left = self.member()
        while self.takes("&&"):
            self.lines()
            left = Binary("&&", left, self.member())
        return left

    def member(self) -> Node:
        left = self.matching()
        while not self.no_in and self.takes("in"):
            left = In(left.items if isinstance(left, Group) else (left,), self.name())
        return left

    def matching(self) -> Node:
        left = self.compared()
        while op := self.takes("~", "!~"):
            left = Match(left, self.compared(), op == "!~")
        return left

    def compared(self) -> Node:
        left = self.concat()
        while True:
            if self.sees("<", "<=", "==", "!=", ">=") or (self.sees(">") and not self.no_gt):
                op = self.now.text
                self.at += 1
                left = Binary(op, left, self.concat())
            elif self.sees("|") and self.tokens[self.at + 1].text == "getline":
                self.at += 2
                left = Getline(self.target(), left, "|")
            else:
                return left

    _STARTS = ("$", "!", "(", "-", "+", "++", "--")

    def concat(self, no_gt: bool = False) -> Node:
        left = self.summed()
        while self.now.kind in ("number", "string", "regex", "name", "function", "builtin") or self.sees("$", "!", "(", "-", "+", "++", "--"):
            if self.sees("!") and self.tokens[self.at + 1].text in ("~",):
                break
            left = Binary(" ", left, self.summed())
        return left

    def summed(self) -> Node:
        left = self.product()
        while op := self.takes("+", "-"):
            left = Binary(op, left, self.product())
        return left

    def product(self) -> Node:
        left = self.signed()
        while op := self.takes("*", "/", "%"):
            left = Binary(op, left, self.signed())
        return left

    def signed(self) -> Node:
        if op := self.takes("!", "-", "+"):
            return Unary(op, self.signed())
        return self.power()

    def power(self) -> Node:
        base = self.stepped()
        if self.takes("^"):
            # Right-associative; a sign may stand before the exponent.
            if op := self.takes("-", "+", "!"):
                return Binary("^", base, Unary(op, self.power()))
            return Binary("^", base, self.power())
        return base

    def stepped(self) -> Node:
        if op := self.takes("++", "--"):
            target = self.primary()
            if not isinstance(target, (Var, Field, Index)):
                raise self.fail(f"{op} of something that cannot be assigned")
            return Step(op, target, True)
        left = self.primary()
        if isinstance(left, (Var, Field, Index)) and self.sees("++", "--"):
            op = self.now.text
            self.at += 1
            return Step(op, left, False)
        return left

    def target(self) -> Node | None:
        """What getline reads into, if it says so."""
        if self.now.kind == "name" or self.sees("$"):
            return self.primary()
        return None

    def list(self, close: str) -> tuple[Node, ...]:
        items: list[Node] = []
        before = self.no_in, self.no_gt
        self.no_in = self.no_gt = False
        self.lines()
        while not self.takes(close):
            items.append(self.expr())
            self.lines()
            if not self.sees(close):
                self.must(",")
                self.lines()
        self.no_in, self.no_gt = before
        return tuple(items)

    def subscripts(self) -> tuple[Node, ...]:
        keys = self.list("]")
        if not keys:
            raise self.fail("a subscript is missing")
        return keys

    def primary(self) -> Node:
        t = self.now
        self.at += 1
        if t.kind == "number":
            return Num(float(int(t.text, 16)) if t.text[:2] in ("0x", "0X") else float(t.text))
        if t.kind == "string":
            return Str(t.text)
        if t.kind == "regex":
            return Regex(t.text)
        if t.kind == "name":
            if self.takes("["):
                return Index(t.text, self.subscripts())
            return Var(t.text)
        if t.kind == "function":
            self.must("(")
            return Call(t.text, self.list(")"))
        if t.kind == "builtin":
            return self.builtin(t.text)
        if t.text == "$" and t.kind == "op":
            if op := self.takes("++", "--"):
                return Field(Step(op, self.primary(), True))
            if op := self.takes("-", "+", "!"):
                return Field(Unary(op, self.primary()))
            # In $$0++ the step belongs to the inner field, in $i++ to the outer one.
            return Field(self.stepped() if self.sees("$") else self.primary())
        if t.text == "(" and t.kind == "op":
            items = self.list(")")
            if not items:
                raise self.fail("empty parentheses")
            if len(items) > 1 and not self.sees("in") and self.now.kind not in ("newline", "end") and not self.sees(";", "}", ">", ">>", "|"):
                raise self.fail("a list in parentheses stands only before in, or after print")
            return Group(items)
        if t.text == "getline" and t.kind == "keyword":
            target = self.target()
            if self.takes("<"):
                return Getline(target, self.stepped(), "<")
            return Getline(target, None, "")
        if t.kind == "op" and t.text in ("!", "-", "+"):
            return Unary(t.text, self.signed())
        self.at -= 1
        raise self.fail(f"unexpected {t.text!r}")

    def builtin(self, name: str) -> Node:
        least, most = BUILTINS[name]
        if not self.sees("("):
            if name == "length":
                return Builtin(name, ())
            raise self.fail(f"expected '(' after {name}")
        self.must("(")
        args = self.list(")")
        if len(args) < least or (most is not None and len(args) > most):
            raise self.fail(f"wrong number of arguments for {name}")
        if name in ("sub", "gsub") and len(args) == 3 and not isinstance(args[2], (Var, Field, Index)):
            raise self.fail(f"the third argument of {name} must be assignable")
        if name == "split" and not isinstance(args[1], Var):
            raise self.fail("the second argument of split must be an array")
        return Builtin(name, args)


def parse(source: str) -> Program:
    return Parser(source).program()


def same(a: Node, b: Node) -> bool:
    """Whether two expressions are written alike."""
    return strip(a) == strip(b)


def strip(node: Node) -> Node:
    """An expression without parentheses around single expressions."""
    return rewrite(node, lambda n: n.items[0] if isinstance(n, Group) and len(n.items) == 1 else n)


def rewrite(node: Any, change: Callable[[Node], Node]) -> Any:
    """A copy of a tree with change applied to every node, from below."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if not isinstance(node, Node):
        return node
    return change(type(node)(*[rewrite(getattr(node, f.name), change) for f in fields(node)]))
