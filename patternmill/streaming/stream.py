"""Programs over Structured Streaming sources.

Stateless programs run unchanged on a stream. Programs whose arrays are read only in END are
aggregations: each trigger gives the END of all records so far (output mode complete).
Programs that read an array by one subscript while they go, such as running totals, keep
that key's elements as state; a scalar that lasts belongs to no key and is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..api import Config, Program
from ..errors import CompileError
from ..functions.columns import text as as_text
from ..functions.values import Strnum, text
from ..operators.sequential import Machine
from ..plans import syntax as S
from ..plans.flow import lasting
from ..sources.records import Records


def stream_program(source: str, stream: DataFrame, columns: list[str], fields: list[str] | None = None, config: Config | None = None) -> tuple[DataFrame, str]:
    """A streaming DataFrame of what the program prints, and the output mode to write it with."""
    program = Program(source)
    records = Records(stream, tuple(fields or stream.columns), None)
    if any(n in (S.Var("NR"), S.Var("FNR")) for n in S.walk(program.tree)):
        raise CompileError("a stream's records have no numbers")
    plan = program.plan(records, config, columns)
    if plan.tier not in ("A", "B"):
        raise CompileError(f"no plan over a stream: {plan.reason}")
    return plan.df, "append" if plan.tier == "A" else "complete"


def keyed_state(source: str, stream: DataFrame, columns: list[str], key: int, fields: list[str] | None = None) -> DataFrame:
    """A program whose arrays are all subscripted by field `key`, run key by key; arrays are the state.

    Records of one key arrive in the order of the trigger's batches. Write with output mode update.
    """
    program = Program(source)
    names = fields or stream.columns
    for n in S.walk(program.tree.rules):
        if isinstance(n, (S.Index, S.In)) and S.strip(n.keys[0]) != S.Field(S.Num(float(key))):
            raise CompileError(f"array {n.array} has a subscript other than ${key}")
    held = {n.array for n in S.walk((program.tree.rules, tuple(program.tree.functions.values()))) if isinstance(n, (S.Index, S.In, S.ForIn, S.Delete))}
    if scalars := lasting(program.tree) - held:
        raise CompileError(f"{min(scalars)} lasts from record to record, but is not kept by key")
    if any(n in (S.Var("NR"), S.Var("FNR")) or isinstance(n, S.Getline) for n in S.walk(program.tree)) or any(r.until for r in program.tree.rules):
        raise CompileError("a stream's records have no numbers, no ranges and no next one")
    records = Records(stream, tuple(names), None)
    rows = stream.select(*[as_text(records.value(i + 1)).alias(f"f{i + 1}") for i in range(len(names))])
    tree = program.tree

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(tree, fs="\x1f", ofs="\x1f", structured=True)
        machine.run_begin()
        if state.exists:
            machine.arrays |= {a: {k: _restored(v) for k, v in own.items()} for a, own in json.loads(state.get[0]).items()}
        for batch in batches:
            machine.run_records(iter("\x1f".join("" if v is None else v for v in row) for row in batch.itertuples(index=False)))
        state.update((json.dumps({a: {k: _stored(v) for k, v in machine.arrays[a].items()} for a in machine.arrays_global if a not in ("ARGV", "ENVIRON")}),))
        yield pd.DataFrame([[text(v) for v in row] for row in machine.out], columns=columns, dtype=object)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return rows.groupBy(f"f{key}").applyInPandasWithState(run, schema, "arrays string", "update", GroupStateTimeout.NoTimeout)


def _stored(v) -> list:
    """A value with its kind, which JSON would lose: n for numbers, i for input, s for strings."""
    return ["n" if v is None or isinstance(v, float) else "i" if isinstance(v, Strnum) else "s", v]


def _restored(v: list):
    return Strnum(v[1]) if v[0] == "i" else v[1]
