"""A record's rules executed once, on columns instead of values.

Assignments become columns under guards, output becomes guarded rows, and what lasts from
one record to the next becomes a list of updates for each variable, from which the planner
makes aggregates or windows. Whatever has no such form raises Unplannable with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PatternmillError
from ..functions import columns as C
from ..functions import regexes
from ..functions.columns import Val
from ..plans import syntax as S
from ..sources.records import NR, Records, split_column


class Unplannable(PatternmillError):
    """A construct that has no DataFrame form here; the reason is its message."""


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def choose(guard: Column | None, new: Val, old: Val) -> Val:
    """new where the guard holds, else old."""
    if guard is None:
        return new
    if new.kind == old.kind:
        return replace(new, col=F.when(guard, new.col).otherwise(old.col), whole=new.whole and old.whole, ascii=new.ascii and old.ascii, nullable=new.nullable or old.nullable).on(old)
    if "null" in (new.kind, old.kind) and "num" in (new.kind, old.kind):
        a, b = (v.col.cast("double") if v.kind == "num" else F.lit(None).cast("double") for v in (new, old))
        return Val(F.when(guard, a).otherwise(b), "num", nullable=True).on(new, old)
    if {new.kind, old.kind} <= {"str", "null"}:
        return Val(F.when(guard, C.text(new)).otherwise(C.text(old)), "str").on(new, old)
    raise Unplannable("a variable's kind depends on the path")


@dataclass(frozen=True)
class Line:
    """A record that is text: its line and the array of its fields."""

    value: Column
    fields: Column
    fs: str
    kind: str = "strnum"
    strings: frozenset = frozenset()

    @staticmethod
    def of(value: Column, fs: str, kind: str = "strnum") -> Line:
        return Line(value, split_column(value, fs), fs, kind)

    def line(self) -> Val:
        return Val(self.value, self.kind)

    def field(self, k: int) -> Val:
        return Val(F.get(self.fields, F.lit(k - 1)), "str" if k in self.strings else "strnum")

    def at(self, k: Column) -> Val:
        return Val(F.when(k == 0, self.value).otherwise(F.get(self.fields, F.when(k > 0, k).otherwise(F.lit(2_000_000_000)).cast("int") - 1)), "strnum")

    def count(self) -> Val:
        return Val(F.size(self.fields), "num", whole=True)

    def with_field(self, k: int, v: Val, ofs: str, fmt: str) -> Line:
        # No lambda: a formatted number is a Python function, which lambdas cannot hold.
        padded = F.concat(self.fields, F.array_repeat(F.lit(""), F.greatest(F.lit(k) - F.size(self.fields), F.lit(0))))
        tail = F.slice(padded, F.lit(k + 1), F.greatest(F.size(padded) - k, F.lit(0)))
        fields = F.concat(F.slice(padded, 1, k - 1), F.array(C.text(v, fmt)), tail)
        strings = self.strings | {k} if v.kind == "str" else self.strings - {k}
        return replace(self, value=F.array_join(fields, ofs), fields=fields, kind="strnum", strings=frozenset(strings))

    def with_count(self, n: Column, ofs: str) -> Line:
        n = F.greatest(n.cast("int"), F.lit(0))
        padded = F.concat(self.fields, F.array_repeat(F.lit(""), F.greatest(n - F.size(self.fields), F.lit(0))))
        fields = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(padded, 1, F.greatest(n, F.lit(1))))
        return replace(self, value=F.array_join(fields, ofs), fields=fields, kind="strnum")

    def guarded(self, guard: Column | None, new: Line) -> Line:
        if guard is None:
            return new
        return replace(new, value=F.when(guard, new.value).otherwise(self.value), fields=F.when(guard, new.fields).otherwise(self.fields), kind=new.kind if new.kind == self.kind else "strnum")


@dataclass(frozen=True)
class Row:
    """A table's row: typed values, with the line made only where it is read."""

    values: tuple[Val, ...]
    records: Records
    ofs: str
    fs: str

    def line(self) -> Val:
        return Val(self.records.line(list(self.values), self.ofs), "strnum")

    def field(self, k: int) -> Val:
        return self.values[k - 1] if 0 < k <= len(self.values) else C.string("")

    def at(self, k: Column) -> Val:
        every = F.array(*[C.text(v) for v in self.values])
        return Val(F.when(k == 0, self.line().col).otherwise(F.get(every, F.when(k > 0, k).otherwise(F.lit(2_000_000_000)).cast("int") - 1)), "strnum")

    def count(self) -> Val:
        return Val(F.lit(len(self.values)), "num", whole=True)

    @property
    def fields(self) -> Column:
        return F.array(*[C.text(v) for v in self.values])

    def with_field(self, k: int, v: Val, ofs: str, fmt: str) -> Row:
        values = list(self.values) + [C.string("")] * (k - len(self.values))
        values[k - 1] = v
        return replace(self, values=tuple(values), ofs=ofs)

    def with_count(self, n: Column, ofs: str) -> Row:
        raise Unplannable("NF of a table is assigned")

    def guarded(self, guard: Column | None, new: Row | Line) -> Row | Line:
        if guard is None:
            return new
        if isinstance(new, Line):
            return Line(self.line().col, self.fields, self.fs).guarded(guard, new)
        old = list(self.values) + [C.string("")] * (len(new.values) - len(self.values))
        return replace(new, values=tuple(choose(guard, n, o) if n is not o else n for n, o in zip(new.values, old, strict=True)))


@dataclass
class Update:
    """What one statement does to a lasting variable: add, set, most, least, times, append or drop."""

    op: str
    guard: Column | None
    value: Val
    order: Val | None = None  # set beside most or least: the value that decides


@dataclass
class State:
    """A variable that lasts. keys: an array's subscripts, the same in every use."""

    name: str
    keys: tuple[Val, ...] | None = None
    updates: list[Update] = field(default_factory=list)
    read: bool = False
    asked: bool = False  # by in, before this record's update
    kind: str = "num"

    @property
    def column(self) -> str:
        return f"__prev_{self.name}"


@dataclass
class Output:
    guard: Column | None
    values: list[Val]
    formatted: bool = False
    to: Val | None = None
    how: str = ""
    command: str | None = None  # what | names, where it is a constant


@dataclass
class Running:
    """A lasting variable's value inside a record, after the updates so far; read only if used."""

    state: State
    add: Column | None


class Symbolic:
    def __init__(self, program: S.Program, constants: dict, kinds: dict[str, str], lookups: dict, record: Line | Row | None, names: Records | None):
        self.program, self.constants, self.kinds, self.lookups = program, constants, kinds, lookups
        self.record, self.names = record, names
        self.env: dict[str, Val | Running] = {}
        self.splits: dict[str, Column] = {}
        self.states: dict[str, State] = {}
        self.outputs: list[Output] = []
        self.left: Column | None = None
        self.exits: list[Column] = []
        self.numbered = False
        self.joins: dict[tuple[str, str], tuple[Val, ...]] = {}
        self.assigned = {t.name for n in S.walk((program.rules, tuple(program.functions.values()))) for t in [getattr(n, "target", None)] if isinstance(t, S.Var)}
        self.assigned |= {n.name for n in S.walk(program.rules) if isinstance(n, S.ForIn)}
        self.exploded: tuple[str, Column] | None = None
        self.calls: list[str] = []

    # -- constants

    def special(self, name: str) -> str:
        return self.constants.get(name, {"OFS": " ", "FS": " ", "ORS": "\n", "SUBSEP": "\x1c", "CONVFMT": "%.6g", "OFMT": "%.6g"}[name])

    @property
    def fmt(self) -> str:
        return self.special("CONVFMT")

    # -- statements

    def here(self, guard: Column | None) -> Column | None:
        return both(guard, None if self.left is None else ~self.left)

    def run(self, s: S.Node | None, guard: Column | None = None) -> None:
        if s is None:
            return
        if isinstance(s, S.Block):
            for x in s.body:
                self.run(x, guard)
        elif isinstance(s, S.Expr):
            self.effect(s.value, guard)
        elif isinstance(s, S.Print):
            values = [self.value(a, guard) for a in s.args] if s.args else [self.record_line()]
            if s.formatted:
                values = [Val(C.formatted(self.constant(s.args[0]), values[1:]), "str").on(*values)]
            to = S.strip(s.to) if s.to is not None else None
            command = to.value if s.how == "|" and isinstance(to, S.Str) else None
            self.outputs.append(Output(self.here(guard), values, s.formatted, self.value(to, guard) if to is not None else None, s.how, command))
        elif isinstance(s, S.If):
            if self.extreme(s, guard):
                return
            test = F.coalesce(C.holds(self.value(s.test, guard)), F.lit(False))
            self.branch(test, guard, lambda g: self.run(s.yes, g), lambda g: self.run(s.no, g))
        elif isinstance(s, S.For):
            self.loop(s, guard)
        elif isinstance(s, S.Jump) and s.kind in ("next", "nextfile"):
            here = self.here(guard)
            now = F.lit(True) if here is None else F.coalesce(here, F.lit(False))
            self.left = now if self.left is None else self.left | now
        elif isinstance(s, S.Exit):
            here = self.here(guard)
            now = F.lit(True) if here is None else F.coalesce(here, F.lit(False))
            self.exits.append(now)
            self.left = now if self.left is None else self.left | now
        elif isinstance(s, S.Delete) and s.keys is not None:
            self.update(S.Index(s.array, s.keys), "drop", C.number(0), guard)
        else:
            raise Unplannable(f"{type(s).__name__.lower()} has no plan here")

    def branch(self, test: Column, guard: Column | None, yes, no=None) -> None:
        """Runs both branches, each on its own variables, and joins what they leave.

        Sums and the like stand under the guard already, so they pass from one branch to the next.
        """
        base = dict(self.env)
        yes(both(guard, test))
        left = self.env
        self.env = {**{k: v for k, v in base.items() if isinstance(v, Val)}, **{k: v for k, v in left.items() if isinstance(v, Running)}}
        if no is not None:
            no(both(guard, ~test))
        for name in list(dict.fromkeys([*left, *self.env])):
            a, b = left.get(name), self.env.get(name)
            if a is b or isinstance(a, Running) or isinstance(b, Running):
                continue
            a, b = (v if v is not None else self.before(name) for v in (a, b))
            self.env[name] = choose(test, a, b)

    def before(self, name: str) -> Val:
        """A variable's value from before this record, if any rule can see it."""
        return self.read(name) if self.reads_later(name) else C.nothing()

    def record_line(self) -> Val:
        if self.record is None:
            raise Unplannable("the record is read where there is none")
        return self.record.line()

    def constant(self, e: S.Node) -> str:
        e = S.strip(e)
        if isinstance(e, S.Str):
            return e.value
        if isinstance(e, S.Var) and e.name not in self.assigned and isinstance(self.constants.get(e.name), str):
            return self.constants[e.name]
        raise Unplannable("a format or separator is computed")

    def loop(self, s: S.For, guard: Column | None) -> None:
        """A counted loop with constant bounds is written out; others are left to the planner's explode."""
        init, test, step = s.init, s.test, s.step
        try:
            name = init.value.target.name
            first, last = init.value.value.value, S.strip(test.right).value
            up = isinstance(step.value, S.Step) and step.value.op == "++" and step.value.target.name == name
            fits = isinstance(test, S.Binary) and test.op in ("<", "<=") and S.strip(test.left) == S.Var(name) and up and last - first <= 64
        except AttributeError:
            fits = False
        if not fits or any(isinstance(n, S.Jump) and n.kind in ("break", "continue") for n in S.walk(s.body)):
            raise Unplannable("a loop over a number of steps that is not constant")
        i = first
        while i < last or (test.op == "<=" and i == last):
            self.env[name] = C.number(i)
            self.run(S.rewrite(s.body, lambda n, i=i: S.Num(i) if n == S.Var(name) else n), guard)
            i += 1.0
        self.env[name] = C.number(i)

    def extreme(self, s: S.If, guard: Column | None) -> bool:
        """if (x > m) m = x, with more set beside it: a running or final maximum."""
        test, seeded = S.strip(s.test), False
        if isinstance(test, S.Binary) and test.op == "||":
            seed = S.strip(test.left)
            seeded = isinstance(seed, S.Binary) and seed.op == "==" and (seed.left == S.Var("NR") or seed.right == S.Str(""))
            if not seeded and not (isinstance(seed, S.Unary) and seed.op == "!" and isinstance(S.strip(seed.operand), S.In)):
                return False
            seeded, test = True, S.strip(test.right)
        if not (isinstance(test, S.Binary) and test.op in ("<", ">", "<=", ">=")) or s.no is not None:
            return False
        body = s.yes.body if isinstance(s.yes, S.Block) else (s.yes,)
        if not all(isinstance(x, S.Expr) and isinstance(x.value, S.Assign) and x.value.op == "=" and isinstance(x.value.target, (S.Var, S.Index)) for x in body):
            return False
        sides = {"<": (test.right, test.left), ">": (test.left, test.right), "<=": (test.right, test.left), ">=": (test.left, test.right)}[test.op]
        for x, m, op in ((sides[0], sides[1], "most"), (sides[1], sides[0], "least")):
            target = S.strip(m)
            own = [b.value for b in body if S.strip(b.value.target) == target and S.same(b.value.value, x)]
            lasting = isinstance(target, S.Index) or (isinstance(target, S.Var) and target.name not in self.env)
            if len(own) == 1 and lasting:
                value = self.value(x, guard)
                if value.kind != "num":
                    return False  # input compares as text where it does not look like a number
                start = guard
                if not seeded:
                    begun = self.constants.get(target.name) if isinstance(target, S.Var) else None
                    floor = F.lit(float(begun) if isinstance(begun, (int, float)) else 0.0)
                    start = both(guard, C.num(value) > floor if op == "most" else C.num(value) < floor)
                self.update(target, op, value, start)
                for b in body:
                    if b.value is not own[0]:
                        if isinstance(b.value.target, S.Index):
                            raise Unplannable("an array is set beside a maximum")
                        self.update(b.value.target, f"at {op}", self.value(b.value.value, guard), start, value)
                return True
        return False

    # -- lasting variables

    def update(self, target: S.Node, op: str, value: Val, guard: Column | None, order: Val | None = None) -> None:
        state = self.state(target)
        state.updates.append(Update(op, self.here(guard), value, order))
        key = target.name if isinstance(target, S.Var) else state.name
        if op == "add":
            before = self.env.get(key)
            here = self.here(guard)
            part = C.num(value) if here is None else F.when(here, C.num(value)).otherwise(F.lit(0.0))
            so_far = before.add if isinstance(before, Running) and before.add is not None else None
            self.env[key] = Running(state, part if so_far is None else so_far + part)
        elif op != "set":
            self.env[key] = Running(state, None)

    def state(self, target: S.Node) -> State:
        if isinstance(target, S.Var):
            return self.states.setdefault(target.name, State(target.name, kind=self.kinds.get(target.name, "null")))
        keys = self.keys(target.keys)
        known = self.states.setdefault(target.array, State(target.array, keys, kind=self.kinds.get(target.array, "null")))
        if str([k.col for k in known.keys]) != str([k.col for k in keys]):
            raise Unplannable(f"array {target.array} is used with different subscripts")
        return known

    def keys(self, nodes: tuple[S.Node, ...]) -> tuple[Val, ...]:
        """Subscripts; a key joined by SUBSEP is several."""
        if any(isinstance(n, (S.Assign, S.Step)) for n in S.walk(nodes)):
            raise Unplannable("a subscript changes a variable")
        out: list[Val] = []
        for n in nodes:
            parts = self.pieces(S.strip(n))
            if len(parts) == 3 and parts[1] == S.Var("SUBSEP"):
                out += [self.value(parts[0]), self.value(parts[2])]
            else:
                out.append(self.value(n))
        return tuple(out)

    @staticmethod
    def pieces(e: S.Node) -> list[S.Node]:
        """The operands of a chain of concatenations."""
        parts, flat = [], [e]
        while flat:
            x = S.strip(flat.pop(0))
            if isinstance(x, S.Binary) and x.op == " ":
                flat[:0] = [x.left, x.right]
            else:
                parts.append(x)
        return parts

    def previous(self, state: State) -> Val:
        state.read = True
        kind = state.kind
        return Val(F.col(state.column), kind, nullable=kind == "num", deps=frozenset({state.name}))

    # -- expressions

    def effect(self, e: S.Node, guard: Column | None) -> None:
        """An expression statement."""
        e = S.strip(e)
        if isinstance(e, S.Step):
            e = S.Assign("+=" if e.op == "++" else "-=", e.target, S.Num(1.0))
        if isinstance(e, S.Assign):
            self.assign(e, guard)
        else:
            self.value(e, guard)

    def assign(self, e: S.Assign, guard: Column | None) -> Val | None:
        target = e.target
        if isinstance(target, S.Field):
            value = self.value(e.value if e.op == "=" else S.Binary(e.op[0], target, e.value), guard)
            self.set_field(target, value, guard)
            return value
        if isinstance(target, S.Var) and target.name in ("FS", "RS", "OFS", "ORS", "SUBSEP", "CONVFMT", "OFMT", "NR", "FNR", "FILENAME"):
            raise Unplannable(f"{target.name} is assigned in a rule")
        if isinstance(target, S.Var) and target.name == "NF":
            n = C.num(self.value(e.value if e.op == "=" else S.Binary(e.op[0], target, e.value), guard))
            self.record = self.record.guarded(self.here(guard), self.record.with_count(n, self.special("OFS")))
            return Val(n, "num")
        name = target.name if isinstance(target, S.Var) else target.array
        if name in self.lookups or name in self.splits:
            raise Unplannable(f"{name} is changed in a rule")
        local = isinstance(target, S.Var) and isinstance(self.env.get(name), Val)
        value_node = S.strip(e.value)
        if not local and e.op in ("+=", "-="):
            v = self.value(e.value, guard)
            self.update(target, "add", v if e.op == "+=" else Val(-C.num(v), "num").on(v), guard)
            return None
        if not local and e.op == "*=":
            self.update(target, "times", self.value(e.value, guard), guard)
            return None
        if not local and e.op == "=" and isinstance(value_node, S.Binary) and value_node.op == " ":
            first, *rest = self.pieces(value_node)
            if first == target and not any(n == target for n in S.walk(rest)):
                v = self.value(rest[0], guard)
                for x in rest[1:]:
                    v = C.concat(v, self.value(x, guard), self.fmt)
                self.update(target, "append", v, guard)
                return None
        if not local and e.op == "=" and isinstance(value_node, S.Binary) and value_node.op in ("+", "*") and S.strip(value_node.left) == target and not any(n == target for n in S.walk(value_node.right)):
            v = self.value(value_node.right, guard)
            self.update(target, {"+": "add", "*": "times"}[value_node.op], v, guard)
            return None
        if e.op != "=":
            e = S.Assign("=", target, S.Binary(e.op[0], target, e.value))
        value = self.value(e.value, guard)
        if isinstance(target, S.Index):
            self.update(target, "set", value, guard)
            self.env[name] = Running(self.states[name], None)
            return value
        if isinstance(self.env.get(name), Running):
            raise Unplannable(f"{name} is both accumulated and assigned")
        self.update(target, "set", value, guard)
        self.env[name] = value
        return value

    def reads_later(self, name: str) -> bool:
        """Whether any rule reads the variable, so that its value from before matters."""
        writes = {id(n.target) for n in S.walk(self.program.rules) if isinstance(n, S.Assign) and n.op == "="}
        return any(isinstance(n, S.Var) and n.name == name and id(n) not in writes for n in S.walk(self.program.rules))

    def set_field(self, target: S.Field, value: Val, guard: Column | None) -> None:
        index = S.strip(target.index)
        if not isinstance(index, S.Num):
            raise Unplannable("a computed field is assigned")
        k = int(index.value)
        if k == 0:
            new = Line.of(C.text(value, self.fmt), self.special("FS"), "str" if value.kind == "str" else "strnum")
        else:
            new = self.record.with_field(k, value, self.special("OFS"), self.fmt)
        self.record = self.record.guarded(self.here(guard), new)

    def value(self, e: S.Node, guard: Column | None = None) -> Val:
        e = S.strip(e)
        return getattr(self, f"_{type(e).__name__.lower()}")(e, guard)

    def __getattr__(self, name: str):
        raise Unplannable(f"{name.strip('_')} has no plan here") if name.startswith("_") and not name.startswith("__") else AttributeError(name)

    def _num(self, e, guard):
        return C.number(e.value)

    def _str(self, e, guard):
        if any("\udc80" <= c <= "\udcff" for c in e.value):
            raise Unplannable("a string holds bytes that are no character")
        return C.string(e.value)

    def _regex(self, e, guard):
        return C.flag(C.matches(self.record_line(), e.source))

    def _group(self, e, guard):
        parts = [C.text(self.value(x, guard), self.fmt) for x in e.items]
        return Val(F.concat_ws(self.special("SUBSEP"), *parts), "str")

    def _var(self, e, guard):
        return self.read(e.name)

    def read(self, name: str) -> Val:
        if name in ("NR", "FNR") and isinstance(self.env.get(name), Val):
            return self.env[name]
        if name in ("NR", "FNR"):
            self.numbered = True
            return Val(F.col(NR), "num")
        if name == "NF":
            return self.record.count()
        if name == "FILENAME":
            return Val(self.names.name, "str") if self.names is not None and self.names.name is not None else C.string("")
        if name in ("FS", "OFS", "ORS", "SUBSEP", "CONVFMT", "OFMT"):
            return C.string(self.special(name))
        known = self.env.get(name)
        if isinstance(known, Val):
            return known
        if isinstance(known, Running):
            if known.add is None:
                raise Unplannable(f"{name} is read after an update that is no sum")
            before = self.previous(known.state)
            return Val(C.num(before) + known.add, "num").on(before)
        if name in self.assigned:
            return self.previous(self.state(S.Var(name)))
        return self.literal(name)

    def literal(self, name: str) -> Val:
        v = self.constants.get(name)
        return C.nothing() if v is None else C.number(v) if isinstance(v, (int, float)) else C.string(str(v))

    def _field(self, e, guard):
        index = S.strip(e.index)
        if isinstance(index, S.Num):
            return self.record_line() if index.value == 0 else self.record.field(int(index.value)) if index.value > 0 else C.string("")
        if self.exploded and self.exploded[0] == "$" and index == S.Var(self.exploded[1]):
            return Val(F.col("__item"), "strnum")
        if index == S.Var("NF") and isinstance(self.record, Row):
            return self.record.field(len(self.record.values))
        return self.record.at(C.num(self.value(index, guard)))

    def _unary(self, e, guard):
        v = self.value(e.operand, guard)
        if e.op == "!":
            return C.flag(~F.coalesce(C.holds(v), F.lit(False))).on(v)
        return Val(-C.num(v) if e.op == "-" else C.num(v), "num").on(v)

    def _binary(self, e, guard):
        a = self.value(e.left, guard)
        if e.op in ("&&", "||"):
            x = C.holds(a)
            # The right side, with what it changes, counts only where the left side leaves it open.
            b = self.value(e.right, both(guard, x if e.op == "&&" else ~F.coalesce(x, F.lit(False))))
            y = C.holds(b)
            return C.flag(x & y if e.op == "&&" else x | y).on(a, b)
        b = self.value(e.right, guard)
        if e.op == " ":
            return C.concat(a, b, self.fmt)
        return C.compared(e.op, a, b) if e.op in C._OPS else C.arithmetic(e.op, a, b)

    def _match(self, e, guard):
        v, right = self.value(e.left, guard), S.strip(e.right)
        source = right.source if isinstance(right, S.Regex) else self.constant(right)
        found = C.matches(v, source, self.fmt)
        return C.flag(~found if e.negated else found).on(v)

    def _cond(self, e, guard):
        test = self.value(e.test, guard)
        holds = F.coalesce(C.holds(test), F.lit(False))
        yes, no = self.value(e.yes, both(guard, holds)), self.value(e.no, both(guard, ~holds))
        if yes.kind == no.kind or "null" in (yes.kind, no.kind):
            return choose(holds, yes, no).on(test)
        return Val(F.when(holds, C.text(yes, self.fmt)).otherwise(C.text(no, self.fmt)), "strnum").on(test, yes, no)

    def _assign(self, e, guard):
        value = self.assign(e, guard)
        return value if value is not None else self.value(e.target, guard)

    def _step(self, e, guard):
        """The value of x++ or ++x of a lasting number, or of a record's own."""
        by = 1.0 if e.op == "++" else -1.0
        if isinstance(e.target, S.Field) or isinstance(self.env.get(getattr(e.target, "name", "")), Val):
            old = self.value(e.target, guard)
            new = Val(C.num(old) + by, "num").on(old)
            if isinstance(e.target, S.Field):
                self.set_field(e.target, new, guard)
            else:
                self.env[e.target.name] = choose(self.here(guard), new, old)
            return new if e.pre else Val(C.num(old), "num").on(old)
        old = self.value(e.target, guard)
        self.update(e.target, "add", C.number(by), guard)
        return Val(C.num(old) + (by if e.pre else 0.0), "num").on(old)

    def _index(self, e, guard):
        if e.array in self.splits:
            index = S.strip(e.keys[0])
            if self.exploded == (e.array, getattr(index, "name", None)):
                return Val(F.col("__item"), "str")
            return Val(F.coalesce(F.get(self.splits[e.array], C.num(self.value(index, guard)).cast("int") - 1), F.lit("")), "str")
        if e.array in self.lookups:
            return self.looked_up(e.array, self.keys(e.keys))[1]
        known = self.env.get(e.array)
        state = self.state(e)
        if isinstance(known, Running):
            if known.add is None:
                raise Unplannable(f"{e.array} is read after an update that is no sum")
            before = self.previous(state)
            return Val(C.num(before) + known.add, "num").on(before)
        return self.previous(state)

    def _in(self, e, guard):
        if e.array in self.lookups:
            return self.looked_up(e.array, self.keys(e.keys))[0]
        state = self.state(S.Index(e.array, e.keys))
        if isinstance(self.env.get(e.array), Running):
            raise Unplannable("in is asked after an update")
        state.asked = True
        return C.flag(F.col(f"__has_{state.name}")).on(Val(F.lit(0), "num", deps=frozenset({state.name})))

    def looked_up(self, array: str, keys: tuple[Val, ...]) -> tuple[Val, Val]:
        """Whether a lookup table has a key, and its value, as columns of a join that the planner adds."""
        at = (array, str([k.col for k in keys]))
        self.joins.setdefault(at, keys)
        number = list(self.joins).index(at)
        kind = self.lookups[array][1]
        return C.flag(F.col(f"__found_{number}").isNotNull()), Val(F.coalesce(F.col(f"__value_{number}"), F.lit("")) if kind != "num" else F.col(f"__value_{number}"), kind, nullable=kind == "num")

    def _call(self, e, guard):
        f = self.program.functions[e.name]
        if e.name in self.calls:
            raise Unplannable(f"function {e.name} is recursive")
        bound = dict(zip(f.params, e.args, strict=False))
        if any(isinstance(n, (S.Assign, S.Step, S.Print, S.Getline, S.ForIn, S.While, S.For, S.Delete)) for n in S.walk(f.body)):
            raise Unplannable(f"function {e.name} is more than an expression")
        body = self.returned(f.body.body)
        inner = S.rewrite(body, lambda n: S.Group((bound[n.name],)) if isinstance(n, S.Var) and n.name in bound else S.Str("") if isinstance(n, S.Var) and n.name in f.params else n)
        self.calls.append(e.name)
        try:
            return self.value(inner, guard)
        finally:
            self.calls.pop()

    def returned(self, body: tuple[S.Node, ...]) -> S.Node:
        """A function body of ifs and returns as one expression."""
        if not body:
            return S.Str("")
        first, rest = body[0], body[1:]
        if isinstance(first, S.Block):
            return self.returned(first.body + rest)
        if isinstance(first, S.Return):
            return first.value if first.value is not None else S.Str("")
        if isinstance(first, S.If):
            no = (first.no,) if first.no is not None else ()
            return S.Cond(first.test, self.returned((first.yes, *rest)), self.returned((*no, *rest)))
        raise Unplannable("a function is more than an expression")

    def _builtin(self, e, guard):
        name, args = e.name, e.args
        if name in ("sub", "gsub"):
            return self.substitution(e, guard)
        if name == "split":
            source = C.text(self.value(args[0], guard), self.fmt)
            sep = S.strip(args[2]) if len(args) > 2 else S.Str(self.special("FS"))
            if isinstance(sep, S.Regex):
                parts = F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(source, regexes.translate(sep.source), -1))
            else:
                by = self.constant(sep)
                parts = F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(source, "")) if by == "" else split_column(source, by)
            self.splits[args[1].name] = parts
            return Val(F.size(parts), "num", whole=True)
        if name == "match":
            s, pattern = C.text(self.value(args[0], guard), self.fmt), S.strip(args[1])
            source = F.lit(regexes.translate(pattern.source if isinstance(pattern, S.Regex) else self.constant(pattern)))
            found, at = F.regexp_substr(s, source), F.regexp_instr(s, source)
            start = F.when(at == 0, 0.0).otherwise(F.octet_length(F.substring(s, F.lit(1), at - 1)) + 1.0)
            self.env["RSTART"] = Val(start, "num")
            self.env["RLENGTH"] = Val(F.when(at == 0, -1.0).otherwise(F.octet_length(found).cast("double")), "num")
            return Val(start, "num")
        if name == "length" and args and isinstance(S.strip(args[0]), S.Var) and S.strip(args[0]).name in self.splits:
            return Val(F.size(self.splits[S.strip(args[0]).name]), "num", whole=True)
        values = [self.value(a, guard) for a in args]
        if name == "sprintf":
            return Val(C.formatted(self.constant(args[0]), values[1:]), "str").on(*values)
        out = self.pure(name, values)
        return out.on(*values)

    def pure(self, name: str, v: list[Val]) -> Val:
        text = lambda i: C.text(v[i], self.fmt)
        number = lambda i: C.num(v[i])
        if name == "length":
            return Val(C.byte_length(text(0) if v else C.text(self.record_line())), "num")
        if name == "substr":
            return Val(C.substr(text(0), number(1), number(2) if len(v) > 2 else None), "str")
        if name == "index":
            return Val(C.position(text(0), text(1)), "num")
        if name in ("tolower", "toupper"):
            return Val((F.lower if name == "tolower" else F.upper)(text(0)), "str")
        numeric = {"sin": F.sin, "cos": F.cos, "exp": F.exp, "sqrt": F.sqrt, "log": C.logarithm, "int": C.truncated}
        if name in numeric:
            return Val(numeric[name](number(0)), "num")
        if name == "atan2":
            return Val(F.atan2(number(0), number(1)), "num")
        if name == "rand":
            seed = self.constants.get("srand")
            return Val(F.rand(int(seed)) if isinstance(seed, (int, float)) else F.rand(), "num")
        if name in ("close", "fflush"):
            return C.number(0)
        raise Unplannable(f"{name} has no plan here")

    def substitution(self, e: S.Builtin, guard: Column | None) -> Val:
        pattern = S.strip(e.args[0])
        source = pattern.source if isinstance(pattern, S.Regex) else self.constant(pattern)
        target = e.args[2] if len(e.args) > 2 else S.Field(S.Num(0.0))
        old = C.text(self.value(target, guard), self.fmt)
        count, new = C.replaced(old, source, self.constant(e.args[1]), e.name == "gsub")
        value = Val(new, "str")
        if isinstance(target, S.Field):
            self.set_field(target, value, guard)
        elif isinstance(target, S.Var):
            self.env[target.name] = choose(self.here(guard), value, self.env.get(target.name, value))
        else:
            raise Unplannable("an array element is substituted in")
        return Val(count, "num")
