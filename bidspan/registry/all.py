"""Import every section and expose the finished registry."""

from __future__ import annotations

import importlib
import pkgutil

import bidspan.registry as package
from bidspan.registry.core import QUERIES, TWINS, with_common
from bidspan.registry.twin import COMMON

for module in pkgutil.iter_modules(package.__path__):
    if module.name.startswith("s") and module.name[1].isdigit():
        importlib.import_module(f"bidspan.registry.{module.name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: with_common(sql, COMMON) for name, sql in TWINS.items()}
