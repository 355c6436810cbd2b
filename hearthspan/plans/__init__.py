"""Registered queries, one module per family."""

from importlib import import_module
from pkgutil import iter_modules

from hearthspan.plans.base import PLANS, SQL


def load():
    for module in iter_modules(__path__):
        if module.name != "base":
            import_module(f"{__name__}.{module.name}")
    return PLANS, SQL
