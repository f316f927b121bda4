"""The queries of this subpackage, by name, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

import finrecon.llm as package


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _modules() for name, f in vars(module).items() if name.startswith(f"op{int(module.__name__[-2:])}_")}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for module in _modules() if hasattr(module, "SQL") for name in vars(module) if name.startswith(f"op{int(module.__name__[-2:])}_")}


def _modules() -> list:
    names = sorted(m.name for m in iter_modules(package.__path__) if m.name[:2] == "op" and m.name[2:].isdigit())
    return [import_module(f"{package.__name__}.{n}") for n in names]
