"""Named queries of the core, by module."""

from __future__ import annotations

import importlib
import pkgutil


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if m.name[0] != "_"]
