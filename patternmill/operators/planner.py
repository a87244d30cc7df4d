"""From a program to a DataFrame.

Tier A (stateless): select, filter and explode. Tier B (aggregate): what lasts is read only
in END, so it becomes groupBy. Tier C (scan): what lasts is read in the rules, so it becomes
windows over the input's order. Tier D (sequential): anything else; programs whose records
do not depend on each other run record by record in every partition, others in one ordered
stream. The tier and the reason are part of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PatternmillError
from ..functions import columns as C
from ..functions.columns import Val
from ..functions.values import text
from ..plans import syntax as S
from ..plans.flow import lasting
from ..sources.records import CHUNK, FIELDS, NR, POS, Records, split_column
from .batched import Batched, Unbatchable
from .ordered import carried, in_range
from .sequential import Machine
from .symbolic import Line, Output, Row, State, Symbolic, Unplannable


@dataclass
class Plan:
    tier: str
    reason: str
    df: DataFrame
    text: bool
    begun: Machine
    order: tuple[str, ...] = ()


@dataclass
class Options:
    fs: str | None = None
    ofs: str | None = None
    variables: dict = field(default_factory=dict)
    args: list[str] = field(default_factory=list)
    tables: dict[str, Records] = field(default_factory=dict)
    columns: list[str] | None = None
    posix: bool = False
    allow_shell: bool = False
    sequential: bool = False


def plan(program: S.Program, records: Records, options: Options) -> Plan:
    """The plan of a program over records; options.columns asks for columns instead of lines of text."""
    structured = options.columns is not None
    loads, begin = lookups_of(program, options)
    if options.posix and (two := two_operands(program, records)) is not None:
        program, records, body = two[0], two[1], two[2]
        begin = program.begin
        loads |= _load(program, body, S.Getline(None, None, "<"), two[3], options)
    machine = Machine(replace(program, begin=begin), fs=options.fs, ofs=options.ofs, variables=options.variables, args=options.args, posix=options.posix, allow_shell=options.allow_shell, structured=structured)
    went_on = machine.run_begin()
    constants = {k: v for k, v in machine.g.items() if k not in ("NR", "FNR", "NF")}
    if "srand" in program.source:
        constants["srand"] = machine.seed
    if any(machine.arrays[a] for a in machine.arrays_global if a not in ("ARGV", "ENVIRON")):
        options = replace(options, sequential=True)
    if not went_on:
        records = replace(records, df=records.df.limit(0))
    try:
        if options.sequential:
            raise Unplannable("BEGIN fills arrays")
        made = Planner(program, records, options, constants, loads).plan()
        tier, reason, df = made
        return Plan(tier, reason, df, not structured, machine)
    except Unplannable as e:
        return sequential(program, records, options, loads, str(e), machine)


# ---- lookups loaded in BEGIN


def lookups_of(program: S.Program, options: Options) -> tuple[dict, tuple[S.Block, ...]]:
    """Arrays that BEGIN fills from registered tables, as DataFrames, and BEGIN without those loops.

    The loop is while ((getline [line] < "name") > 0) body, where body sets elements of arrays
    from the line's fields or from split(line, parts).
    """
    loads: dict[str, tuple[DataFrame, str]] = {}
    begin = []
    for block in program.begin:
        rest = []
        for s in block.body:
            test = S.strip(s.test) if isinstance(s, S.While) else None
            read = S.strip(test.left) if isinstance(test, S.Binary) and test.op == ">" else None
            name = S.strip(read.source).value if isinstance(read, S.Getline) and isinstance(S.strip(read.source), S.Str) else None
            if name in options.tables:
                loads |= _load(program, s.body, read, options.tables[name], options)
            else:
                rest.append(s)
        begin.append(S.Block(tuple(rest)))
    return loads, tuple(begin)


def two_operands(program: S.Program, records: Records) -> tuple[S.Program, Records, S.Block, Records] | None:
    """NR == FNR { ...; next } over several operands: the first is a table that the other rules look up.

    Returns the other rules, the other operands, the body without next, and the first operand.
    """
    first = program.rules[0] if program.rules else None
    if len(records.parts) < 2 or first is None or first.until is not None or first.body is None or len(first.body.body) < 2:
        return None
    test = S.strip(first.pattern) if first.pattern is not None else None
    if test not in (S.Binary("==", S.Var("NR"), S.Var("FNR")), S.Binary("==", S.Var("FNR"), S.Var("NR"))) or first.body.body[-1] != S.Jump("next"):
        return None
    rest = replace(program, rules=program.rules[1:])
    if any(n in (S.Var("NR"), S.Var("FNR")) for n in S.walk((rest.rules, rest.end, tuple(program.functions.values())))):
        return None  # numbers run on over both
    others = records.parts[1:]
    return rest, others[0] if len(others) == 1 else Records.concat(list(others)), S.Block(first.body.body[:-1]), records.parts[0]


def _load(program: S.Program, body: S.Node, read: S.Getline, records: Records, options: Options) -> dict:
    own = records.ordered()
    record = _record(own, options, {})
    inner = Symbolic(replace(program, rules=(S.Rule(None, None, S.Block((body,))),)), {}, {}, {}, record, own)
    line = read.target.name if isinstance(read.target, S.Var) else None
    if line:
        # split(line, parts) gives the table's own fields.
        body = S.rewrite(body, lambda n: S.Num(0.0) if isinstance(n, S.Builtin) and n.name == "split" and n.args[0] == S.Var(line) else n)
        parts = {n.args[1].name for n in S.walk(s_body(read, program)) if isinstance(n, S.Builtin) and n.name == "split" and n.args[0] == S.Var(line)}
        body = S.rewrite(body, lambda n: S.Field(n.keys[0]) if isinstance(n, S.Index) and n.array in parts else n)
    inner.run(body)
    out = {}
    for name, state in inner.states.items():
        if any(u.op not in ("set", "add") for u in state.updates) or len(state.updates) != 1 or not state.keys:
            raise Unplannable(f"lookup {name} is more than a table")
        u = state.updates[0]
        keys = [F.coalesce(C.text(k), F.lit("")).alias(f"k{i}") if k.kind != "num" else k.col.alias(f"k{i}") for i, k in enumerate(state.keys)]
        rows = own.df if u.guard is None else own.df.filter(u.guard)
        last = F.struct(CHUNK, POS)
        value = F.max_by(u.value.col, last) if u.op == "set" else F.sum(C.num(u.value))
        out[name] = (rows.groupBy(*keys).agg(value.alias("value")), u.value.kind if u.op == "set" else "num", [k.kind for k in state.keys])
    return out


def s_body(read: S.Getline, program: S.Program) -> list[S.Node]:
    return [s.body for b in program.begin for s in S.walk(b) if isinstance(s, S.While) and any(n == read for n in S.walk(s.test))]


def _record(records: Records, options: Options, constants: dict) -> Line | Row:
    fs = constants.get("FS") or options.fs or " "
    if records.columns is None:
        return Line(F.col("value"), F.col(FIELDS), fs) if FIELDS in records.df.columns else Line.of(F.col("value"), fs)
    values = tuple(records.value(k) for k in range(1, len(records.columns) + 1))
    return Row(values, records, options.ofs or constants.get("OFS") or " ", fs)


# ---- rules


class Planner:
    def __init__(self, program: S.Program, records: Records, options: Options, constants: dict, loads: dict):
        if records.columns is None and any(n == S.Var("NF") or (isinstance(n, S.Field) and n.index != S.Num(0.0)) for n in S.walk(program.rules)):
            records = records.split(constants.get("FS") or options.fs or " ")
        self.program, self.records, self.options, self.constants, self.loads = program, records, options, constants, loads
        #: What END reads.
        self.ends = {n.name for n in S.walk(program.end) if isinstance(n, S.Var)} | {n.array for n in S.walk(program.end) if isinstance(n, (S.Index, S.In, S.ForIn))}

    def plan(self) -> tuple[str, str, DataFrame]:
        if any(isinstance(n, S.Getline) for n in S.walk(self.program.rules)):
            raise Unplannable("getline in a rule")
        kinds: dict[str, str] = {}
        for _ in range(3):  # the kinds of what lasts are known after a first look
            body = self.execute(kinds)
            found = {name: self.kind_of(state) for name, state in body.states.items()}
            if found == kinds:
                break
            kinds = found
        df, body = self.carry(body)
        parts: list[DataFrame] = []
        if body.outputs:
            parts.append(self.rows(df, body.outputs))
        if self.program.end:
            parts += self.end(df, body)
        if not parts:
            parts.append(self.rows(df.limit(0), [Output(None, [C.string("")] * len(self.options.columns or [""]))]))
        scans = any(s.read or s.asked for s in body.states.values()) or body.numbered or self.ranged or body.exits
        tier = "C" if scans else "B" if self.program.end else "A"
        reason = {"A": "records do not depend on each other", "B": "what lasts is read only in END", "C": "records read what came before them"}[tier]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p) if not self.options.columns else out.union(p)
        return tier, reason, out

    def execute(self, kinds: dict[str, str]) -> Symbolic:
        """The rules, once, on columns."""
        record = _record(self.records, self.options, self.constants)
        body = Symbolic(self.program, self.constants, kinds, self.loads, record, self.records)
        self.ranged: dict[str, tuple[Column, Column, Column | None]] = {}
        self.explode: tuple[Column | None, Column] | None = None
        for i, rule in enumerate(self.program.rules):
            guard = None
            if rule.pattern is not None and rule.until is None and rule.body is not None and body.extreme(S.If(rule.pattern, rule.body, None), None):
                continue
            if rule.pattern is not None and rule.until is not None:
                reach = body.here(None)
                self.ranged[f"__range_{i}"] = (C.holds(body.value(rule.pattern)), C.holds(body.value(rule.until)), reach)
                guard = F.col(f"__range_{i}")
            elif rule.pattern is not None:
                guard = C.holds(body.value(rule.pattern))
            if rule.body is None:
                body.outputs.append(Output(body.here(guard), [body.record_line()] if not self.whole_row() else list(body.record.values)))
            elif not self.exploded(rule, guard, body):
                if guard is None:
                    body.run(rule.body)
                else:
                    body.branch(F.coalesce(guard, F.lit(False)) if rule.until is None and self.remembers(rule) else guard, None, lambda g, b=rule.body: body.run(b, g))
        return body

    @staticmethod
    def remembers(rule: S.Rule) -> bool:
        """Whether a rule assigns variables; the guard of one that does not reaches the scan as it is."""
        return any(isinstance(n, (S.Assign, S.Step)) for n in S.walk(rule.body))

    def whole_row(self) -> bool:
        return self.options.columns is not None and self.records.columns is not None and len(self.options.columns) == len(self.records.columns)

    def exploded(self, rule: S.Rule, guard: Column | None, body: Symbolic) -> bool:
        """A rule that ends with a loop over all fields, or all pieces of a split, becomes one row a piece."""
        statements = rule.body.body
        loop = statements[-1] if statements else None
        if not isinstance(loop, S.For) or len(self.program.rules) != 1:
            return False
        try:
            name = loop.init.value.target.name
            starts = loop.init.value.value == S.Num(1.0)
            bound = S.strip(loop.test.right)
            up = isinstance(loop.step.value, S.Step) and loop.step.value.op == "++" and loop.step.value.target == S.Var(name)
            if not (starts and up and loop.test.op == "<=" and S.strip(loop.test.left) == S.Var(name)):
                return False
        except AttributeError:
            return False
        for s in statements[:-1]:
            body.run(s, guard)
        used = {n.array for n in S.walk(loop.body) if isinstance(n, S.Index) and n.array in body.splits}
        if bound == S.Var("NF"):
            items, kind = body.record.fields, "$"
        elif len(used) == 1:
            kind = used.pop()
            items = body.splits[kind]
        else:
            return False
        if any(s.read or s.asked or name in self.ends for name, s in body.states.items()):
            raise Unplannable("a loop over fields beside other lasting variables")
        self.explode = (guard, items)
        body.exploded = (kind, name)
        body.env[name] = Val(F.col("__at") + 1, "num", whole=True)
        body.run(loop.body, None)
        return True

    def kind_of(self, state: State) -> str:
        if all(u.op in ("add", "times", "most", "least", "drop") for u in state.updates) and state.updates:
            return "num"
        if all(u.op == "append" for u in state.updates) and state.updates:
            return "str"
        found = {u.value.kind for u in state.updates if u.op in ("set", "at most", "at least")}
        if len(found) == 1 and "null" not in found:
            return found.pop()
        return "num" if not found else "strnum" if found <= {"strnum", "str"} else "num"

    # -- what is carried

    def carry(self, body: Symbolic) -> tuple[DataFrame, Symbolic]:
        records = self.records
        reads = [s for s in body.states.values() if s.read or s.asked]
        ordered = reads or self.ranged or body.exits or any(u.op in ("set", "at most", "at least", "append", "drop") for s in body.states.values() if s.name in self.ends for u in s.updates)
        if body.numbered:
            records = records.numbered()
        elif ordered or self.reads_last():
            records = records.ordered()
        df = records.df
        for i, ((array, _), keys) in enumerate(body.joins.items()):
            table, _, kinds = self.loads[array]
            table = table.select(*[F.col(f"k{j}").alias(f"__k{i}_{j}") for j in range(len(keys))], F.col("value").alias(f"__value_{i}"), F.lit(True).alias(f"__found_{i}"))
            on = None
            for j, (k, kind) in enumerate(zip(keys, kinds, strict=True)):
                own = k.col if k.kind == kind == "num" else C.text(k)
                there = F.col(f"__k{i}_{j}") if k.kind == kind == "num" or kind != "num" else F.col(f"__k{i}_{j}").cast("string")
                on = own == there if on is None else on & (own == there)
            df = df.join(table, on, "left").drop(*[f"__k{i}_{j}" for j in range(len(keys))])
        for name, (start, stop, reach) in self.ranged.items():
            if reach is not None:
                start, stop = start & reach, stop & reach
            df = in_range(df, start, stop, name)
        if self.explode is not None:
            guard, items = self.explode
            df = (df if guard is None else df.filter(guard)).select("*", F.posexplode(items).alias("__at", "__item"))
        waiting = list(reads)
        while waiting:
            names = {s.name for s in waiting}
            ready = [s for s in waiting if not any(v.deps & names for u in s.updates for v in (u.value, *([u.order] if u.order else []))) and not any(k.deps & names for k in s.keys or ())]
            if not ready:
                raise Unplannable(f"{min(names)} depends on its own earlier values")
            for s in ready:
                df = self.carried_one(df, s)
                waiting.remove(s)
        if body.exits:
            # The first record that exits is the last one that counts.
            out = F.lit(False)
            for e in body.exits:
                out = out | e
            df = carried(df, {"__gone": ("max", out.cast("int"))}).filter(F.coalesce(F.col("__gone"), F.lit(0)) == 0).drop("__gone")
        return df, body

    def reads_last(self) -> bool:
        """Whether END reads the last record."""
        return any(isinstance(n, (S.Field, S.Regex)) or (isinstance(n, S.Print) and not n.args) or n == S.Var("NF") for n in S.walk(self.program.end))

    def carried_one(self, df: DataFrame, s: State) -> DataFrame:
        ops = {u.op for u in s.updates}
        keys = [F.coalesce(C.text(k), F.lit("")) if k.kind != "num" else k.col for k in s.keys] if s.keys else None
        begun = self.constants.get(s.name)
        columns: dict[str, tuple[str, Column]] = {}
        if s.asked:
            touched = F.lit(0)
            for u in s.updates:
                touched = touched + (F.lit(1) if u.guard is None else F.when(u.guard, 1).otherwise(0))
            columns[f"__n_{s.name}"] = ("sum", touched)
        if s.read or not s.asked:
            if ops == {"add"}:
                part = None
                for u in s.updates:
                    x = C.num(u.value) if u.guard is None else F.when(u.guard, C.num(u.value))
                    part = x if part is None else F.coalesce(part, F.lit(0.0)) + F.coalesce(x, F.lit(0.0))
                columns[s.column] = ("sum", part)
            elif ops == {"set"}:
                columns[s.column] = ("last", self.latest(s))
            elif ops in ({"most"}, {"least"}) and len(s.updates) == 1:
                u = s.updates[0]
                x = C.num(u.value) if u.guard is None else F.when(u.guard, C.num(u.value))
                columns[s.column] = ("max" if ops == {"most"} else "min", x)
            else:
                raise Unplannable(f"{s.name} is read while it is updated by {', '.join(sorted(ops)) or 'nothing'}")
        df = carried(df, columns, keys)
        if s.asked:
            df = df.withColumn(f"__has_{s.name}", F.coalesce(F.col(f"__n_{s.name}"), F.lit(0)) > 0).drop(f"__n_{s.name}")
        if s.column in columns:
            c = F.col(s.column)
            if ops == {"set"}:
                c = c["v"]
            if isinstance(begun, (int, float)) and s.kind == "num":
                c = F.coalesce(c, F.lit(0.0)) + float(begun) if ops == {"add"} else F.coalesce(c.cast("double"), F.lit(float(begun)))
            elif isinstance(begun, str) and s.kind != "num":
                c = F.coalesce(c, F.lit(begun))
            df = df.withColumn(s.column, c)
        return df

    def latest(self, s: State) -> Column:
        """What a record leaves in a variable: a struct, null where it leaves it alone."""
        out = None
        for u in s.updates:
            value = F.struct((u.value.col if u.value.kind != "null" else F.lit(None).cast("string")).alias("v"))
            out = value if u.guard is None else F.when(u.guard, value) if out is None else F.when(u.guard, value).otherwise(out)
        return out

    # -- output rows

    def rows(self, df: DataFrame, outputs: list[Output]) -> DataFrame:
        names = self.options.columns
        ofs, ofmt = self.constants.get("OFS", " "), self.constants.get("OFMT", "%.6g")
        commands = {o.command for o in outputs if o.how == "|"}
        if commands:
            order = sort_order(commands.pop()) if len(commands) == 1 and all(o.how == "|" for o in outputs) else None
            if order is None:
                raise Unplannable("output goes to a command")
            return self.sorted_rows(self.rows(df, [replace(o, to=None, how="") for o in outputs]), *order)
        if any(o.to is not None for o in outputs):
            made = [(o.guard, [F.lit("") if o.to is None else C.text(o.to), self.joined(o, ofs, ofmt)]) for o in outputs]
            return self.exploded_rows(df, made, ["dest", "value"])
        if names is None:
            return self.exploded_rows(df, [(o.guard, [self.joined(o, ofs, ofmt)]) for o in outputs], ["value"])
        if any(len(o.values) != len(names) for o in outputs):
            raise Unplannable(f"not every print has {len(names)} values")
        made = []
        for o in outputs:
            row = []
            for i, v in enumerate(o.values):
                kinds = {x.values[i].kind for x in outputs}
                whole = all(x.values[i].whole for x in outputs)
                if kinds == {"num"}:
                    row.append(v.col if whole or len(outputs) == 1 else v.col.cast("double"))
                else:
                    row.append(v.col if len(outputs) == 1 and v.kind != "null" else C.text(v, ofmt))
            made.append((o.guard, row))
        return self.exploded_rows(df, made, names)

    def sorted_rows(self, df: DataFrame, keys: list[tuple[int, bool, bool]], limit: int | None) -> DataFrame:
        """print | "sort": an ORDER BY on fields, or the line where the field is 0; | head: its LIMIT."""
        names, kinds, by = df.columns, dict(df.dtypes), []
        for key, numeric, descending in keys:
            if not self.options.columns:
                field = F.get(split_column(F.col("value"), " "), F.lit(key - 1)) if key else F.col("value")
                own = [C.parsed(field) if numeric else F.coalesce(field, F.lit(""))]
            else:
                own = [F.col(f"`{n}`") for n in ([names[key - 1]] if key else names)]
                if numeric:
                    own = [c.cast("double") if kinds[n] == "string" else c for c, n in zip(own, [names[key - 1]] if key else names, strict=True)]
                elif key:
                    own = [own[0].cast("string")]
            by += [c.desc() if descending else c.asc() for c in own]
        out = df.orderBy(*by)
        return out if limit is None else out.limit(limit)

    def joined(self, o: Output, ofs: str, ofmt: str) -> Column:
        return F.concat_ws(ofs, *[C.text(v, ofmt) for v in o.values])

    def exploded_rows(self, df: DataFrame, made: list[tuple[Column | None, list[Column]]], names: list[str]) -> DataFrame:
        if len(made) == 1:
            guard, row = made[0]
            return (df if guard is None else df.filter(guard)).select(*[c.alias(n) for c, n in zip(row, names, strict=True)])
        parts = []
        for guard, row in made:
            value = F.struct(*[c.alias(n) for c, n in zip(row, names, strict=True)])
            parts.append(value if guard is None else F.when(guard, value))
        return df.select(F.explode(F.array_compact(F.array(*parts))).alias("__o")).select(*[F.col(f"__o.`{n}`").alias(n) for n in names])

    # -- END

    def end(self, df: DataFrame, body: Symbolic) -> list[DataFrame]:
        return End(self, df, body).plan()


class End(Symbolic):
    """END over the final values: a row of scalars, and a grouped table for each array."""

    def __init__(self, planner: Planner, df: DataFrame, body: Symbolic):
        super().__init__(planner.program, planner.constants, {}, planner.loads, None, None)
        self.planner, self.rules_df, self.body = planner, df, body
        self.parts: list[DataFrame] = []
        self.numbered = False
        self.scalars: DataFrame | None = None
        self.used = {n.name for n in S.walk(planner.program.end) if isinstance(n, S.Var)}
        self.loop_over: str | None = None
        self.loop_name: str | None = None
        self.assigned = set()
        self.grouped_names: dict[str, DataFrame] = {}

    def plan(self) -> list[DataFrame]:
        aggregates = []
        for s in self.body.states.values():
            if s.keys is None and s.name in self.used:
                aggregates.append(self.final(s).alias(s.name))
                self.env[s.name] = Val(F.col(s.name), s.kind, nullable=s.kind == "num")
        last = F.struct(CHUNK, POS)
        if "NR" in self.used or "FNR" in self.used:
            aggregates.append(F.count(F.lit(1)).alias("NR"))
            for name in ("NR", "FNR"):
                self.env[name] = Val(F.col("NR"), "num", whole=True)
        lengths = [n for n in S.walk(self.planner.program.end) if isinstance(n, S.Builtin) and n.name == "length" and n.args and isinstance(n.args[0], S.Var) and n.args[0].name in self.body.states and self.body.states[n.args[0].name].keys]
        for n in lengths:
            s = self.body.states[n.args[0].name]
            key = F.struct(*[k.col for k in s.keys])
            touched = [u.guard for u in s.updates]
            on = None if any(g is None for g in touched) else touched[0]
            aggregates.append(F.countDistinct(key if on is None else F.when(on, key)).alias(f"__length_{s.name}"))
        records = self.planner.reads_last()
        if records:
            if isinstance(self.body.record, Row):
                aggregates += [F.max_by(v.col, last).alias(f"__last_{i}") for i, v in enumerate(self.body.record.values)]
            else:
                aggregates += [F.max_by(self.body.record.value, last).alias("__last")]
        source = self.rules_df
        self.scalars = source.agg(*aggregates) if aggregates else None
        if records:
            if isinstance(self.body.record, Row):
                self.record = replace(self.body.record, values=tuple(replace(v, col=F.col(f"__last_{i}")) for i, v in enumerate(self.body.record.values)))
            else:
                self.record = Line.of(F.coalesce(F.col("__last"), F.lit("")), self.body.record.fs)
        for block in self.planner.program.end:
            for s in block.body:
                self.top(s)
        self.flush()
        return self.parts

    def one_row(self) -> DataFrame:
        return self.scalars if self.scalars is not None else self.rules_df.sparkSession.range(1)

    def flush(self) -> None:
        if self.outputs:
            self.parts.append(self.planner.rows(self.one_row(), self.outputs))
            self.outputs = []

    def final(self, s: State) -> Column:
        ops = {u.op for u in s.updates}
        begun = self.constants.get(s.name) if s.keys is None else None
        on = lambda u, c: c if u.guard is None else F.when(u.guard, c)
        order = F.struct(CHUNK, POS)
        if ops == {"add"}:
            total = None
            for u in s.updates:
                part = F.sum(on(u, C.num(u.value)))
                total = part if total is None else F.when(total.isNull(), part).when(part.isNull(), total).otherwise(total + part)
            return F.coalesce(total, F.lit(0.0)) + float(begun) if isinstance(begun, (int, float)) else total
        if ops == {"times"} and len(s.updates) == 1:
            product = F.product(on(s.updates[0], C.num(s.updates[0].value)))
            return product * (float(begun) if isinstance(begun, (int, float)) else 0.0)
        if ops in ({"most"}, {"least"}) and len(s.updates) == 1:
            u = s.updates[0]
            c = on(u, C.num(u.value) if not u.value.whole else u.value.col)
            found = F.max(c) if ops == {"most"} else F.min(c)
            return F.coalesce(found, F.lit(float(begun))) if isinstance(begun, (int, float)) else found
        if ops in ({"at most"}, {"at least"}) and len(s.updates) == 1:
            u = s.updates[0]
            by = C.num(u.order) * (-1 if ops == {"at most"} else 1)
            # Of equal values the first record's stays.
            return F.min_by(u.value.col, on(u, F.struct(by.alias("by"), CHUNK, POS)))
        if ops == {"append"} and len(s.updates) == 1:
            u = s.updates[0]
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(on(u, F.struct(CHUNK, POS, C.text(u.value).alias("t"))))), lambda x: x["t"]), "")
            return F.concat(F.lit(begun if isinstance(begun, str) else ""), joined)
        if ops == {"set"}:
            value = F.max_by(self.planner.latest(s), F.when(self.planner.latest(s).isNotNull(), order))["v"]
            return F.coalesce(value, F.lit(begun)) if isinstance(begun, str) else value
        raise Unplannable(f"{s.name} is updated by {', '.join(sorted(ops))}")

    def grouped(self, array: str) -> DataFrame:
        """One row for each key of an array: its subscripts, its value, and those of arrays with the same subscripts."""
        first = self.body.states.get(array)
        if first is None or first.keys is None:
            raise Unplannable(f"array {array} is not filled by the rules")
        same = [s for s in self.body.states.values() if s.keys is not None and str([k.col for k in s.keys]) == str([k.col for k in first.keys])]
        if any(u.op == "drop" for s in same for u in s.updates):
            raise Unplannable("elements are deleted in the rules")
        keys = [(F.coalesce(C.text(k), F.lit("")) if k.kind != "num" else k.col).alias(f"__key_{i}") for i, k in enumerate(first.keys)]
        counted = [F.count(F.lit(1)) if u.guard is None else F.count_if(u.guard) for u in first.updates]
        touched = counted[0]
        for c in counted[1:]:
            touched = touched + c
        values = [self.final(s).alias(f"__of_{s.name}") for s in same]
        for s in same:
            any_ = F.lit(False)
            for u in s.updates:
                any_ = any_ | (F.lit(True) if u.guard is None else F.coalesce(u.guard, F.lit(False)))
            values.append(F.bool_or(any_).alias(f"__has_{s.name}"))
        df = self.rules_df.groupBy(*keys).agg(touched.alias("__touched"), *values)
        return df if all(u.guard is None for u in first.updates[:1]) else df.filter("__touched > 0")

    def top(self, s: S.Node) -> None:
        """A statement of END outside a loop over an array."""
        if isinstance(s, S.Block):
            for x in s.body:
                self.top(x)
        elif isinstance(s, S.ForIn):
            self.over(s)
        else:
            self.run(s)

    def over(self, s: S.ForIn) -> None:
        self.flush()
        df = self.grouped(s.array)
        state = self.body.states[s.array]
        if self.scalars is not None:
            # One row, so the join neither shuffles nor grows.
            df = df.join(F.broadcast(self.scalars), F.lit(True))
        outer, self.env = self.env, dict(self.env)
        self.loop_over, self.loop_name = s.array, s.name
        kinds = [k.kind for k in state.keys]
        one = len(kinds) == 1
        key = F.col("__key_0") if one else F.concat_ws(self.special("SUBSEP"), *[C.text(Val(F.col(f"__key_{i}"), k)) for i, k in enumerate(kinds)])
        self.env[s.name] = Val(key, kinds[0] if one and kinds[0] == "num" else "str", whole=one and state.keys[0].whole)
        self.states, self.assigned = {}, {t.name for n in S.walk(s.body) for t in [getattr(n, "target", None)] if isinstance(t, S.Var)}
        self.joined_arrays: list[str] = []
        before = set(self.env)
        self.run(s.body)
        reduced = {name: st for name, st in self.states.items() if name not in before or st.updates}
        if self.outputs:
            self.parts.append(self.planner.rows(self.attach(df), self.outputs))
            self.outputs = []
        self.env = outer
        if reduced and not any(st.read for st in reduced.values()):
            df = self.attach(df).withColumn(CHUNK, F.lit("")).withColumn(POS, F.lit(0))
            made = []
            for name, st in reduced.items():
                if self.planner.kind_of(st) == "num" or all(u.op != "set" for u in st.updates):
                    saved, self.constants = self.constants, dict(self.constants)
                    made.append(self.final(st).alias(name))
                    self.constants = saved
                    kind = self.planner.kind_of(st)
                    self.env[name] = Val(F.col(name), kind, nullable=kind == "num")
            if made:
                totals = df.agg(*made)
                old = self.scalars
                if old is not None:
                    keep = [c for c in old.columns if c not in reduced]
                    totals = totals.join(F.broadcast(old.select(*keep)), F.lit(True)) if keep else totals
                self.scalars = totals
        self.states, self.assigned, self.loop_over = {}, set(), None

    def attach(self, df: DataFrame) -> DataFrame:
        """The grouped table joined with the arrays that are read by the same key but filled by other subscripts."""
        first = self.body.states[self.loop_over]
        for name in dict.fromkeys(self.joined_arrays):
            other = self.grouped(name)
            kinds = [(a.kind, b.kind) for a, b in zip(first.keys, self.body.states[name].keys, strict=True)]
            renamed = other.select(*[F.col(f"__key_{i}").alias(f"__other_{i}") for i in range(len(kinds))], F.col(f"__of_{name}"), F.lit(True).alias(f"__has_{name}"))
            on = None
            for i, (a, b) in enumerate(kinds):
                left, right = F.col(f"__key_{i}"), F.col(f"__other_{i}")
                if a != b:
                    left, right = left.cast("string"), right.cast("string")
                on = left == right if on is None else on & (left == right)
            df = df.join(renamed, on, "left").drop(*[f"__other_{i}" for i in range(len(kinds))])
        return df

    def _index(self, e, guard):
        if e.array in self.splits:
            return super()._index(e, guard)
        if self.loop_over and len(e.keys) == 1 and S.strip(e.keys[0]) == S.Var(self.loop_name):
            s = self.body.states.get(e.array)
            if s is not None and s.keys is not None:
                self.meet(e.array)
                return Val(F.col(f"__of_{e.array}"), s.kind if s.kind != "num" or any(u.op == "set" for u in s.updates) else "num", nullable=s.kind == "num")
        raise Unplannable(f"{e.array} is read by a key other than the loop's")

    def meet(self, array: str) -> None:
        first = self.body.states[self.loop_over]
        if str([k.col for k in self.body.states[array].keys]) != str([k.col for k in first.keys]):
            self.joined_arrays.append(array)

    def _in(self, e, guard):
        if self.loop_over and len(e.keys) == 1 and S.strip(e.keys[0]) == S.Var(self.loop_name) and e.array in self.body.states:
            self.meet(e.array)
            return C.flag(F.coalesce(F.col(f"__has_{e.array}"), F.lit(False)))
        raise Unplannable("in is asked in END")

    def _builtin(self, e, guard):
        if e.name == "length" and e.args and isinstance(e.args[0], S.Var) and getattr(self.body.states.get(e.args[0].name), "keys", None):
            return Val(F.col(f"__length_{e.args[0].name}"), "num", whole=True)
        if e.name == "split" and self.loop_over and S.strip(e.args[0]) == S.Var(self.loop_name) and len(e.args) == 3 and S.strip(e.args[2]) == S.Var("SUBSEP"):
            n = len(self.body.states[self.loop_over].keys)
            self.splits[e.args[1].name] = F.array(*[F.col(f"__key_{i}").cast("string") for i in range(n)])
            return C.number(n)
        return super()._builtin(e, guard)


def sort_order(command: str) -> tuple[list[tuple[int, bool, bool]], int | None] | None:
    """Keys (field, numeric, descending; field 0 is the line) of a sort command, and n of `| head -n`; None for any other."""
    first, *rest = [part.split() for part in command.split("|")]
    limit = None
    if rest:
        m = re.fullmatch(r"head(?: -n)? ?-?([0-9]+)", " ".join(rest[0]))
        if len(rest) > 1 or not m:
            return None
        limit = int(m[1])
    if not first or first[0] != "sort":
        return None
    keys, options, words = [], "", first[1:]
    while words:
        w = words.pop(0)
        if w == "-k" and words:
            w += words.pop(0)
        if m := re.fullmatch(r"-k([0-9]+)(?:,\1)?([nr]*)", w):
            keys.append((int(m[1]), m[2]))
        elif re.fullmatch(r"-[nr]+", w):
            options += w[1:]
        else:
            return None
    own = [(k, flags or options) for k, flags in keys or [(0, "")]]
    return [(k, "n" in flags, "r" in flags) for k, flags in own] + ([(0, False, "r" in options)] if keys else []), limit


# ---- record by record


def sequential(program: S.Program, records: Records, options: Options, loads: dict, reason: str, begun: Machine) -> Plan:
    """Tier D: Arrow batches of records through numpy or the evaluator, in each partition or in one ordered stream."""
    inside = list(S.walk((program.rules, tuple(program.functions.values()))))
    stateless = not program.end and not any(isinstance(n, (S.Getline, S.Exit)) or n in (S.Var("NR"), S.Var("FNR")) for n in inside) and not any(r.until for r in program.rules) and not lasting(program, frozenset(loads))
    to_files = any(isinstance(n, S.Print) and n.to is not None and n.how != "|" for n in inside + list(S.walk(program.end)))
    structured = options.columns is not None and not to_files
    names = ["dest", "value"] if to_files else options.columns or ["value"]
    setup = dict(fs=options.fs, ofs=options.ofs, variables=options.variables, args=options.args, posix=options.posix, allow_shell=options.allow_shell, structured=structured)
    given = list(records.columns) if records.columns else ["value"]
    own = records if stateless else records.ordered()
    table, width = records.columns is not None, len(given)
    schema = ", ".join(f"`{c}` string" for c in names)
    if stateless and not loads and not to_files:
        try:
            made = _batched(program, own, begun, names, structured)
            return Plan("D", f"{reason}; whole batches, every partition by itself", own.df.select(*made[0]).mapInArrow(made[1], schema), not structured, begun)
        except Unbatchable as e:
            reason = f"{reason}; {e}"
    line = [C.text(own.value(i + 1)).alias(f"f{i}") for i in range(len(given))] if table else [F.col("value").alias("f0")]
    numeric = [own.value(i + 1).kind == "num" for i in range(len(given))] if table else [False]
    df = own.df.select(*line, *([] if stateless else [CHUNK, POS]))
    if not stateless:
        df = df.repartition(1).sortWithinPartitions(CHUNK, POS).drop(CHUNK, POS)
    first = replace(program, begin=begun.program.begin)
    # Broadcast, so that the tables reach an executor once and not with every task.
    tables = df.sparkSession.sparkContext.broadcast({name: _collected(name, load[0]) for name, load in loads.items()}) if loads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(first, **setup)
        machine.arrays |= {name: dict(rows) for name, rows in tables.value.items()} if tables is not None else {}
        going = machine.run_begin()
        machine.out.clear()  # what BEGIN prints is printed by the driver

        def lines() -> Iterator[str]:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    if table:
                        machine.pending = [x or "" for x in row]
                        yield machine.g["OFS"].join(machine.pending)
                    else:
                        yield row[0] or ""

        if table:
            _typed(machine, numeric, width)
        if going:
            for _ in _drained(machine, lines()):
                if len(machine.out) > 5000 and not to_files:
                    yield _batch(machine.out, names, structured)
                    machine.out.clear()
                elif to_files and sum(map(len, machine.written.values())) + len(machine.out) > 5000:
                    yield _files(machine, names, False)
        machine.run_end()
        yield _files(machine, names, True) if to_files else _batch(machine.out, names, structured)

    return Plan("D", f"{reason}; {'every partition by itself' if stateless else 'one ordered stream'}", df.mapInArrow(run, schema), not structured, begun)


def _batched(program: S.Program, own: Records, begun: Machine, names: list[str], structured: bool) -> tuple[list[Column], object]:
    """The columns that a program reads, and a function of their batches."""
    constants = {k: v for k, v in begun.g.items() if k not in ("NR", "FNR", "NF")}
    fs = text(begun.g["FS"])
    kinds, columns = None, [F.col("value")]
    if own.columns is not None:
        values = [own.value(i + 1) for i in range(len(own.columns))]
        kinds = ["num" if v.kind == "num" else "str" if v.kind == "str" else "input" for v in values]
        columns = [(v.col if v.kind == "num" else C.text(v)).alias(f"f{i}") for i, v in enumerate(values)]
        if not any(isinstance(n, S.Field) and not isinstance(S.strip(n.index), S.Num) for n in S.walk(program.rules)):
            # Fields that no rule reads are not read from the table either.
            read = {int(S.strip(n.index).value) for n in S.walk(program.rules) if isinstance(n, S.Field)}
            columns = [c if i + 1 in read else F.lit(0).alias(f"f{i}") for i, c in enumerate(columns)]
            kinds = [k if i + 1 in read else "num" for i, k in enumerate(kinds)]
    Batched(program, constants, kinds, structured, fs)  # raises what it cannot do

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Batched(program, constants, kinds, structured, fs)
        for batch in batches:
            yield rules.run(batch, names)

    return columns, run


#: Bytes of keys and values of the lookup tables that an evaluator may hold.
LOOKUP_BYTES = 64 << 20


def _collected(name: str, df: DataFrame) -> dict:
    """A lookup table for the evaluator, if it is small enough to be held in memory."""
    keys = [c for c in df.columns if c != "value"]
    size = df.agg(F.sum(sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 16 for c in df.columns), F.lit(0)))).first()[0] or 0
    if size > LOOKUP_BYTES:
        raise PatternmillError(f"lookup {name} has {size} bytes, more than {LOOKUP_BYTES}, and the program cannot be planned as a join")
    value = lambda v: v if v is None or isinstance(v, str) else float(v)
    return {"\x1c".join(text(value(r[k])) for k in keys): value(r["value"]) for r in df.collect()}


def _typed(machine: Machine, numeric: list[bool], width: int) -> None:
    """A table's fields are its columns, whatever the separator."""

    def ready() -> list[str]:
        if not machine.split_done:
            machine.fields = list(machine.pending) if machine.pending is not None and machine.record == machine.g["OFS"].join(machine.pending) else machine.record.split()
            machine.split_done = True
        return machine.fields

    machine.pending = None
    machine.ready = ready


def _drained(machine: Machine, lines: Iterator[str]) -> Iterator[None]:
    """Runs record by record, giving way after each so that output can leave."""
    from .sequential import _Exit, _Next

    machine.source = lines
    try:
        while (line := machine.advance()) is not None:
            machine.set_record(line)
            try:
                for r in machine.rules:
                    r()
            except _Next:
                pass
            yield None
    except _Exit:
        return


def _batch(out: list, names: list[str], structured: bool) -> pa.RecordBatch:
    """What was printed, as rows of columns or of lines."""
    if structured:
        rows = [tuple(text(v) for v in row) for row in out]
        rows = [row + ("",) * (len(names) - len(row)) for row in rows]
        columns = [pa.array([row[i] for row in rows], pa.string()) for i in range(len(names))]
    else:
        lines = "".join(out).split("\n")
        if lines and lines[-1] == "":
            lines.pop()
        columns = [pa.array([x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in lines], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _files(machine: Machine, names: list[str], last: bool) -> pa.RecordBatch:
    """What was printed to files, as rows of a file's name ('' for the output) and a line; unended lines wait."""
    rows: list[tuple[str, str]] = []
    for name, pieces in [("", machine.out), *machine.written.items()]:
        *lines, rest = "".join(pieces).split("\n")
        pieces[:] = [] if last or not rest else [rest]
        rows += [(name, x.encode("utf-8", "surrogateescape").decode("utf-8", "replace")) for x in (lines + [rest] if last and rest else lines)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=names)


__all__ = ["Options", "Plan", "plan", "NR"]
