"""Reading cases, naming and caching tables, writing results."""

from caseloom.sources.cases import cache_table, read_cases, register_table
from caseloom.sources.sinks import Stages, save_table, write_stage

__all__ = ["Stages", "cache_table", "read_cases", "register_table", "save_table", "write_stage"]
