"""Errors of the engine."""

from __future__ import annotations


class PatternmillError(Exception):
    pass


class ParseError(PatternmillError):
    """A program that is not well formed; line and column count from 1."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{line}:{column}: {message}")
        self.message, self.line, self.column = message, line, column


class CompileError(PatternmillError):
    """A program whose names or calls do not fit together."""


class RunError(PatternmillError):
    """A failure while a program runs, such as a division by zero."""


class ExitStatus(PatternmillError):
    """A program that ended by exit with a status other than 0; what it printed is kept."""

    def __init__(self, code: int, output: str = ""):
        super().__init__(f"exit status {code}")
        self.code, self.output = code, output


def is_exit(error: BaseException) -> tuple[bool, int]:
    return (True, error.code) if isinstance(error, ExitStatus) else (False, 0)
