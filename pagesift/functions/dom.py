"""Tree operations on the ``dom`` column as Catalyst expressions.

Selectors are the small subset the extraction rules use: ``tag``, ``.class``,
``#id``, ``tag[attr]`` and ``tag[attr=value]``.  ``first_match`` is
``select_one``: the first element in document order, looked up in ``first``.
Texts of subtrees are cut out of ``texts``.  So the row must still carry the
columns ``texts`` and ``first`` that shredding put beside ``dom``.  All
functions take and return Columns; nothing here runs Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from .sqltext import F

from .text import PY_WS, let

_SEL = re.compile(r"^(?P<tag>[a-z0-9]*)(?:(?P<cls>\.[\w-]+)|(?P<id>#[\w-]+)|"
                  r"\[(?P<attr>[\w-]+)(?:=(?P<val>[^\]]*))?\])?$")


def attr(n: Column, name: str) -> Column:
    """Attribute value or NULL when absent (safe under ANSI)."""
    return F.try_element_at(n["attrs"], F.lit(name))


def has_attr(n: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(n["attrs"], F.lit(name)), F.lit(False))


def has_class(n: Column, cls: str) -> Column:
    """``class`` is a whitespace-separated token list (exact, case-sensitive)."""
    return F.coalesce(F.array_contains(F.split(attr(n, "class"), PY_WS + "+"), F.lit(cls)),
                      F.lit(False))


def is_tag(n: Column, *names: str) -> Column:
    if len(names) == 1:
        return (n["kind"] == "e") & (n["tag"] == names[0])
    return (n["kind"] == "e") & n["tag"].isin(*names)


def matches(n: Column, selector: str) -> Column:
    m = _SEL.match(selector)
    if not m:
        raise ValueError(f"unsupported selector: {selector}")
    cond = (n["kind"] == "e") & (n["pos"] > 0)
    if m["tag"]:
        cond = cond & (n["tag"] == m["tag"])
    if m["cls"]:
        cond = cond & has_class(n, m["cls"][1:])
    if m["id"]:
        cond = cond & F.coalesce(attr(n, "id") == m["id"][1:], F.lit(False))
    if m["attr"]:
        if m["val"] is None:
            cond = cond & has_attr(n, m["attr"])
        else:
            cond = cond & F.coalesce(attr(n, m["attr"]) == m["val"].strip("\"'"), F.lit(False))
    return cond


def first_match(dom: Column, selector: str) -> Column:
    """``select_one(selector)``: the first matching node struct or NULL."""
    if "=" in selector:
        return F.get(F.filter(dom, lambda n: matches(n, selector)), 0)
    return node_at(dom, F.try_element_at(F.col("first"), F.lit(selector)))


def all_matches(dom: Column, selector: str) -> Column:
    return F.filter(dom, lambda n: matches(n, selector))


def descendants(dom: Column, n: Column) -> Column:
    """Nodes strictly inside ``n`` (``slice`` is 1-based, ``pos`` 0-based)."""
    return F.slice(dom, n["pos"] + 2, n["end"] - n["pos"])


def subtree(dom: Column, n: Column) -> Column:
    """``n`` and everything inside it."""
    return F.slice(dom, n["pos"] + 1, n["end"] - n["pos"] + 1)


def node_at(dom: Column, pos: Column) -> Column:
    return F.get(dom, pos)


def stripped_text(dom: Column, n: Column, most: int | None = None) -> Column:
    """``get_text(strip=True)``: plain text nodes (no comments, scripts,
    styles), each stripped, empties dropped, joined without separator.
    ``most``: only the first characters."""
    def cut(v):
        size = node_at(dom, v["end"])["bytes"] - v["bytes"]
        if most is not None:
            size = F.least(size, F.lit(4 * most))     # no character has more bytes
        text = F.substring(F.col("texts"), v["bytes"] + 1, size).cast("string")
        return text if most is None else F.substring(text, 1, most)
    return let(n, cut)


def text_length(dom: Column, n: Column) -> Column:
    """Characters of ``stripped_text``."""
    return node_at(dom, n["end"])["chars"] - n["chars"]


def count_below(dom: Column, n: Column, what: str) -> Column:
    """How many ``anchors`` or ``hrefs`` stand below ``n``."""
    return node_at(dom, n["end"])[what] - n[what]


def raw_text(dom: Column, n: Column) -> Column:
    """``get_text()``: plain text nodes joined as they are."""
    return let(n, lambda v: F.array_join(F.transform(
        F.filter(descendants(dom, v), lambda m: m["kind"] == "t"), lambda m: m["text"]), ""))


def document(dom: Column) -> Column:
    return F.get(dom, 0)
