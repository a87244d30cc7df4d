"""Pattern-action record processing planned as Spark DataFrames."""

from .api import Config, Program, compile, read, run
from .errors import CompileError, ExitStatus, ParseError, PatternmillError, RunError, is_exit
from .sources.records import Records

__all__ = ["Config", "Program", "Records", "compile", "read", "run", "CompileError", "ExitStatus", "ParseError", "PatternmillError", "RunError", "is_exit"]
