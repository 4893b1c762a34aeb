"""Training-data operators. Nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ["bpe", "neighbours", "packing", "rules", "media", "suffixes", "automaton", "urls", "simhash", "sketches"]


def gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"{__name__}.{module}"), name)
    return found


def queries() -> dict:
    return gather("QUERIES")


def oracle_sql() -> dict:
    return gather("SQL")
