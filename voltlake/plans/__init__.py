"""All registered queries."""

import importlib
import pkgutil

from voltlake.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("p_")):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
