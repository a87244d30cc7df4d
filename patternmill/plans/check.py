"""Names: which are arrays, which are scalars, and whether calls fit their functions."""

from __future__ import annotations

from ..errors import CompileError
from .syntax import Builtin, Call, Delete, ForIn, Getline, In, Index, Program, Var, walk

#: The variables that the engine itself reads or sets.
SPECIAL = frozenset("NR FNR NF FS OFS RS ORS SUBSEP CONVFMT OFMT FILENAME RSTART RLENGTH ARGC".split())
SPECIAL_ARRAYS = frozenset(("ARGV", "ENVIRON"))


def arrays_of(program: Program) -> tuple[frozenset[str], dict[str, frozenset[str]]]:
    """The global arrays, and each function's array parameters.

    A name is an array if it is subscripted, looped over, tested by in, deleted or split
    into, or handed to a parameter that is one. Parameters and globals inform each other, so
    the sets grow until nothing changes. Raises CompileError where a name is both.
    """
    scopes: dict[str, set[str]] = {"": set(SPECIAL_ARRAYS), **{f: set() for f in program.functions}}
    parts = {"": (program.begin, program.rules, program.end), **{f.name: f.body for f in program.functions.values()}}

    def owner(scope: str, name: str) -> str:
        return scope if scope and name in program.functions[scope].params else ""

    def add(scope: str, name: str) -> bool:
        known = scopes[owner(scope, name)]
        if name in known:
            return False
        known.add(name)
        return True

    for scope, part in parts.items():
        for n in walk(part):
            if isinstance(n, (Index, Delete, In, ForIn)):
                add(scope, n.array)
            elif isinstance(n, Builtin) and n.name == "split":
                add(scope, n.args[1].name)
            elif isinstance(n, Call):
                if n.name not in program.functions:
                    raise CompileError(f"function {n.name} is not defined")
                if len(n.args) > len(program.functions[n.name].params):
                    raise CompileError(f"too many arguments for {n.name}")
    changed = True
    while changed:
        changed = False
        for scope, part in parts.items():
            for n in walk(part):
                if not isinstance(n, Call):
                    continue
                for param, arg in zip(program.functions[n.name].params, n.args, strict=False):
                    if isinstance(arg, Var):
                        if param in scopes[n.name]:
                            changed |= add(scope, arg.name)
                        elif arg.name in scopes[owner(scope, arg.name)]:
                            changed |= add(n.name, param)
    for scope, part in parts.items():
        passed = {id(a) for n in walk(part) if isinstance(n, Call) for a in n.args}
        passed |= {id(n.args[0]) for n in walk(part) if isinstance(n, Builtin) and n.name == "length" and n.args}
        passed |= {id(n.args[1]) for n in walk(part) if isinstance(n, Builtin) and n.name == "split"}
        for n in walk(part):
            name = n.name if isinstance(n, (Var, ForIn)) else n.target.name if isinstance(n, Getline) and isinstance(n.target, Var) else None
            if name in program.functions:
                raise CompileError(f"{name} is a function, not a variable")
            if name and name in scopes[owner(scope, name)] and id(n) not in passed:
                raise CompileError(f"{name} is an array, but is used as a scalar")
    clash = (SPECIAL & scopes[""]) | (set(program.functions) & scopes[""])
    if clash:
        raise CompileError(f"{min(clash)} cannot be an array")
    return frozenset(scopes[""]), {f: frozenset(scopes[f]) for f in program.functions}
