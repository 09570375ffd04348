"""Column expressions over the strings of configs and run records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that configs and command lines may use for a strategy.
STRATEGIES = {"brute": "brute", "bruteforce": "brute", "inverted": "inverted", "inverted-index": "inverted", "index": "inverted", "hnsw": "hnsw"}


def split_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and an empty string where a text begins or ends with none."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.filter(split_terms(text), lambda t: t != "")


def params_control(params: Column) -> Column:
    """What follows the first ``query=``, up to the next one; else the whole string."""
    return F.coalesce(F.get(F.split(params, "query="), F.lit(1)), params)


def is_integer_string(s: Column) -> Column:
    """An optional sign and at least one digit."""
    return F.coalesce(s.rlike("^[+-]?[0-9]+$"), F.lit(False))


def path_parts(path: str | list[str]) -> list[str]:
    """Parts of an item's path, given as ``a/b/c`` or as a list."""
    return [p for p in path.split("/") if p] if isinstance(path, str) else list(path)


def run_identifier(nlist: Column, payload: str, nprobe: Column) -> Column:
    return F.format_string("index=(IVF%d,%s),query=(nprobe=%d)", nlist, F.lit(payload), nprobe)


def strategy(name: str) -> str:
    """The search strategy that a user's name means; raises for others."""
    try:
        return STRATEGIES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}") from None
