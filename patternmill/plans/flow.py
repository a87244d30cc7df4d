"""Which names carry a value from one record to the next."""

from __future__ import annotations

from . import syntax as S

#: Set by a built-in function rather than by an assignment.
_BY_MATCH = frozenset(("RSTART", "RLENGTH"))


def assigned(node) -> frozenset[str]:
    """Scalars and arrays that a part of a program can change."""
    names: set[str] = set()
    for n in S.walk(node):
        target = getattr(n, "target", None)
        if isinstance(target, S.Var):
            names.add(target.name)
        elif isinstance(target, S.Index):
            names.add(target.array)
        elif isinstance(n, S.ForIn):
            names.add(n.name)
        elif isinstance(n, S.Delete):
            names.add(n.array)
        elif isinstance(n, S.Index):
            names.add(n.array)  # reading an element makes it
        elif isinstance(n, S.Builtin):
            if n.name == "split":
                names.add(n.args[1].name)
            elif n.name == "match":
                names |= _BY_MATCH
            elif n.name in ("sub", "gsub") and len(n.args) > 2 and isinstance(S.strip(n.args[2]), S.Var):
                names.add(S.strip(n.args[2]).name)
    return frozenset(names)


def lasting(program: S.Program, tables: frozenset[str] = frozenset()) -> frozenset[str]:
    """Names that some record may read as an earlier one left them. tables: arrays that only BEGIN fills."""
    changed = assigned((program.rules, tuple(f.body for f in program.functions.values()))) - {"NF"} - tables
    flow = _Flow(program, changed)
    known: frozenset[str] = frozenset()
    for rule in program.rules:
        known = flow.expr(rule.pattern, known)
        after = flow.run(rule.body, known)
        known = after if rule.pattern is None and rule.body is not None and after is not None else known
    used: set[str] = set()
    for f in program.functions.values():
        inside = {n.name for n in S.walk(f.body) if isinstance(n, S.Var)} | {n.array for n in S.walk(f.body) if isinstance(n, (S.Index, S.In, S.ForIn, S.Delete))}
        used |= (inside | assigned(f.body)) - set(f.params)
    special = changed & {"FS", "RS", "OFS", "ORS", "SUBSEP", "CONVFMT", "OFMT", "FILENAME", "NR", "FNR"}
    return frozenset((flow.early | used | special) & changed)


class _Flow:
    """Definite assignment: each method takes the names set so far and gives those set afterwards."""

    def __init__(self, program: S.Program, changed: frozenset[str]):
        self.program, self.changed = program, changed
        self.early: set[str] = set()

    def read(self, name: str, known: frozenset[str]) -> None:
        if name not in known:
            self.early.add(name)

    def run(self, s, known: frozenset[str]) -> frozenset[str] | None:
        """None where a record never goes on behind the statement."""
        if s is None:
            return known
        if isinstance(s, S.Block):
            for x in s.body:
                after = self.run(x, known)
                if after is None:
                    return None
                known = after
            return known
        if isinstance(s, S.Expr):
            return self.expr(s.value, known)
        if isinstance(s, S.Print):
            for a in (*s.args, s.to):
                known = self.expr(a, known)
            return known
        if isinstance(s, S.If):
            known = self.expr(s.test, known)
            yes, no = self.run(s.yes, known), self.run(s.no, known)
            return no if yes is None else yes if no is None else yes & no
        if isinstance(s, S.While):
            if s.at_end:
                inside = self.run(s.body, known)
                leaves = any(isinstance(n, S.Jump) for n in S.walk(s.body))
                after = self.expr(s.test, known if inside is None or leaves else inside)
                return after
            after = self.expr(s.test, known)
            self.run(s.body, after)
            return after
        if isinstance(s, S.For):
            known = self.run(s.init, known)
            after = self.expr(s.test, known)
            inside = self.run(s.body, after)
            leaves = any(isinstance(n, S.Jump) for n in S.walk(s.body))
            self.run(s.step, after if inside is None or leaves else inside)
            return after
        if isinstance(s, S.ForIn):
            self.read(s.array, known)
            self.run(s.body, known | {s.name})
            return known
        if isinstance(s, S.Delete):
            if s.keys is None:
                return known | {s.array}
            for k in s.keys:
                known = self.expr(k, known)
            self.read(s.array, known)
            return known
        if isinstance(s, S.Jump):
            return None if s.kind in ("next", "nextfile") else known
        if isinstance(s, (S.Exit, S.Return)):
            self.expr(s.code if isinstance(s, S.Exit) else s.value, known)
            return None
        return known

    def expr(self, e, known: frozenset[str]) -> frozenset[str]:
        if e is None:
            return known
        if isinstance(e, S.Var):
            self.read(e.name, known)
            return known
        if isinstance(e, (S.Index, S.In)):
            for k in e.keys:
                known = self.expr(k, known)
            self.read(e.array, known)
            return known
        if isinstance(e, S.Cond):
            known = self.expr(e.test, known)
            return self.expr(e.yes, known) & self.expr(e.no, known)
        if isinstance(e, S.Binary) and e.op in ("&&", "||"):
            known = self.expr(e.left, known)
            self.expr(e.right, known)
            return known
        if isinstance(e, (S.Assign, S.Step)):
            if isinstance(e, S.Step) or e.op != "=":
                known = self.expr(e.target, known)
            if isinstance(e, S.Assign):
                known = self.expr(e.value, known)
            if isinstance(e.target, S.Var):
                return known | {e.target.name}
            return self.expr(e.target if isinstance(e.target, S.Index) else e.target.index, known)
        if isinstance(e, S.Builtin):
            for i, a in enumerate(e.args):
                if not (e.name == "split" and i == 1):
                    known = self.expr(a, known)
            if e.name == "split":
                return known | {e.args[1].name}
            return known | _BY_MATCH if e.name == "match" else known
        for name in ("items", "operand", "left", "right", "index", "args", "source"):
            below = getattr(e, name, None)
            for x in below if isinstance(below, tuple) else (below,):
                if isinstance(x, S.Node):
                    known = self.expr(x, known)
        return known
