"""Named queries over the logical tables, grouped by subject."""

from importlib import import_module
from pkgutil import iter_modules

from . import registry


def load_all():
    """Import every query module so that the registry is complete."""
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
    return registry
