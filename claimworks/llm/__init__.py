"""Training-data operators. Each module names its queries and, where SQL can say it, their DuckDB counterpart."""

import importlib
import pkgutil

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _info in pkgutil.iter_modules(__path__):
    if not _info.name.startswith("_"):
        _module = importlib.import_module(f"{__name__}.{_info.name}")
        QUERIES.update(getattr(_module, "QUERIES", {}))
        ORACLE.update(getattr(_module, "ORACLE", {}))
