"""The engine's interface: compile a program, plan it over records, run it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .errors import ExitStatus
from .operators.planner import Options, Plan, plan
from .operators.sequential import Machine
from .operators.sequential import records as cut
from .plans.check import arrays_of
from .plans.syntax import Program as Tree
from .plans.syntax import parse
from .sources.records import Records


@dataclass
class Config:
    """None stands for the language's default, so an empty string is a separator of its own."""

    fs: str | None = None
    rs: str | None = None
    ofs: str | None = None
    ors: str | None = None
    variables: dict = field(default_factory=dict)
    args: list[str] = field(default_factory=list)
    tables: dict[str, Records | DataFrame] = field(default_factory=dict)
    posix: bool = False
    allow_shell: bool = False
    sequential: bool = False
    #: csv or tsv: fields may be quoted, in the input or in what print writes; header: the first record is skipped.
    input_mode: str | None = None
    output_mode: str | None = None
    header: bool = False
    #: Where run() writes as it goes, and threads of a plan on the command line.
    output: TextIO | None = None
    parallel: int = 1


SEPARATORS = {"csv": ",", "tsv": "\t", None: None}


class _Sent(list):
    """Pieces of output that go to a file as they come, some thousand at a time."""

    def __init__(self, file: TextIO):
        super().__init__()
        self.file = file

    def append(self, piece: str) -> None:
        super().append(piece)
        if len(self) > 4096:
            self.send()

    def send(self) -> None:
        self.file.write("".join(self))
        self.clear()


class Program:
    """A compiled program; it can be planned and run any number of times."""

    def __init__(self, source: str):
        self.source = source
        self.tree: Tree = parse(source)
        arrays_of(self.tree)

    def plan(self, records: Records | DataFrame, config: Config | None = None, columns: list[str] | None = None) -> Plan:
        c = config or Config()
        if isinstance(records, DataFrame):
            records = Records.from_table(records)
        tables = {k: v if isinstance(v, Records) else Records.from_table(v) for k, v in c.tables.items()}
        options = Options(c.fs, c.ofs, c.variables, c.args, tables, columns, c.posix, c.allow_shell, c.sequential)
        return plan(self.tree, records, options)

    def to_df(self, records: Records | DataFrame, columns: list[str] | None = None, config: Config | None = None) -> DataFrame:
        """The output as a DataFrame: lines of text in `value`, or the printed values as named columns."""
        return self.plan(records, config, columns).df

    def analyze(self, records: Records | DataFrame, config: Config | None = None, columns: list[str] | None = None) -> tuple[str, str]:
        """The tier (A, B, C or D) and why."""
        p = self.plan(records, config, columns)
        return p.tier, p.reason

    def explain(self, records: Records | DataFrame, config: Config | None = None, columns: list[str] | None = None) -> None:
        p = self.plan(records, config, columns)
        print(f"tier {p.tier}: {p.reason}")
        p.df.explain("formatted")

    def run(self, text: str | Iterable[str] = "", config: Config | None = None) -> str:
        """Runs over text on the driver, for small inputs, and returns what is printed, or writes it to config.output."""
        c = config or Config()
        m = Machine(self.tree, c.fs, c.rs, c.ofs, c.ors, c.variables, c.args, c.posix, c.allow_shell, separated=SEPARATORS[c.input_mode], joined=SEPARATORS[c.output_mode])
        if c.output is not None:
            m.out = _Sent(c.output)
        going = m.run_begin()
        if going and (m.program.rules or m.program.end):
            chunks = [text] if isinstance(text, str) else text
            lines = m.quoted_records(chunks) if m.separated else cut(chunks, m.g["RS"])
            if c.header:
                next(lines, None)
            m.run_records(lines)
        m.run_end()
        m.flush_files() if not any(k.startswith("|") for k in m.written) else self._pipes(m)
        if c.output is not None:
            m.out.send()
        out = "".join(m.out)
        if m.code:
            raise ExitStatus(m.code, out)
        return out

    @staticmethod
    def _pipes(m: Machine) -> None:
        import subprocess

        for name in [k for k in m.written if k.startswith("|")]:
            got = subprocess.run(["sh", "-c", name[1:]], input="".join(m.written.pop(name)).encode("utf-8", "surrogateescape"), stdout=subprocess.PIPE, check=False)
            m.out.append(got.stdout.decode("utf-8", "surrogateescape"))
        m.flush_files()


def compile(source: str) -> Program:  # noqa: A001
    return Program(source)


def run(source: str, text: str = "", config: Config | None = None) -> str:
    return Program(source).run(text, config)


def read(spark: SparkSession, paths: str | list[str], config: Config | None = None) -> Records:
    return Records.from_text(spark, paths, (config or Config()).rs if config and config.rs is not None else "\n")
