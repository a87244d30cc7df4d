"""Where records come from and where output goes."""

from .records import Records
from .sinks import write_by_destination, write_text

__all__ = ["Records", "write_by_destination", "write_text"]
