"""String helpers that give Python's string semantics as Spark Columns.

Python's ``str.strip()`` and ``\\s`` are Unicode-aware, Spark's ``trim`` and
Java's ``\\s`` are not.  The set below is exactly the characters for which
``str.isspace()`` is true; it is built from that rule, not typed in.
"""

from __future__ import annotations

from pyspark.sql import Column
from .sqltext import F

# Characters for which Python's str.isspace() holds (29 of them).
PY_WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _cls(chars: str) -> str:
    """A regex character class (Java and RE2 syntax) for ``chars``."""
    return "[" + "".join("\\x{%X}" % ord(c) for c in chars) + "]"


# Regex class equal to Python's ``\\s`` for str patterns.
PY_WS = _cls(PY_WS_CHARS)
# The ASCII blanks that bs4 collapses in whitespace-only strings.
ASCII_WS_CHARS = " \n\t\f\r"


def py_strip(c: Column) -> Column:
    """``str.strip()``: drop Unicode white space at both ends."""
    return F.btrim(c, F.lit(PY_WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Every run of Unicode white space becomes one blank."""
    return F.regexp_replace(c, PY_WS + "+", " ")


def left_chars(c: Column, n: int) -> Column:
    """``s[:n]`` in code points."""
    return F.substring(c, 1, n)


def cut_with_ellipsis(c: Column, n: int) -> Column:
    """``s[:n] + '...'`` when longer than n, else s."""
    return let(c, lambda s: F.when(F.length(s) > n, F.concat(left_chars(s, n), F.lit("...")))
               .otherwise(s))


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn``.

    Column helpers that refer to an argument several times would otherwise
    copy its whole expression tree at each use (and evaluate it again)."""
    return F.get(F.transform(F.array(value), fn), 0)
