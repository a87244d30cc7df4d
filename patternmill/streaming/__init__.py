"""Programs over unbounded input."""

from .stream import keyed_state, stream_program

__all__ = ["keyed_state", "stream_program"]
