"""Registered queries, one module per operator family."""

import importlib
import pkgutil


def load() -> None:
    """Import every module of this package, which registers its queries."""
    for m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
