"""Probabilistic Datalog on Spark DataFrames."""

from .engine import Engine, engines
from .errors import CompileError, DatalogError, ParseError

__all__ = ["CompileError", "DatalogError", "Engine", "ParseError", "engines"]
