"""Column expressions kept as SQL text until a DataFrame needs them.

The extraction rules are large expressions.  Built from ``pyspark.sql.functions``
each node costs several calls to the JVM, tens of thousands for one query, which
took ten times as long as running it.  ``F`` here offers the same functions, but
an expression is a ``Text``: a ``Column`` that holds SQL and is parsed once, by
``expr``, when a DataFrame first uses it.  Whatever this module does not know, or
what meets an ordinary ``Column``, becomes an ordinary ``Column``, so both kinds
mix freely.
"""

from __future__ import annotations

import inspect
import itertools

from pyspark.sql import functions as SF
from pyspark.sql.classic.column import Column as _Column

_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
_names = itertools.count()


class NotText(Exception):
    """The value has no SQL text here."""


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int) and abs(v) < 1 << 31:
        return str(v)
    if isinstance(v, str) and "${" not in v:
        return "'" + "".join(_ESCAPES.get(c, c) for c in v) + "'"
    raise NotText


def _sql(v) -> str:
    """SQL of an operand: a Text or a plain value."""
    if isinstance(v, Text):
        return v.sql
    if isinstance(v, _Column):
        raise NotText
    return _literal(v)


def _operator(sign: str, method: str, swapped: bool = False):
    def apply(self, other):
        try:
            a, b = self.sql, _sql(other)
        except NotText:
            return getattr(_Column, method)(self, other)
        return Text(f"({b} {sign} {a})" if swapped else f"({a} {sign} {b})")
    return apply


def _call(name: str, method: str):
    def apply(self, other):
        try:
            return Text(f"{name}({self.sql}, {_sql(other)})")
        except NotText:
            return getattr(_Column, method)(self, other)
    return apply


class Text(_Column):
    """A Column known by its SQL."""

    def __new__(cls, *args):
        return object.__new__(cls)

    def __init__(self, sql: str):
        self.sql = sql
        self._made = None

    @property
    def _jc(self):
        if self._made is None:
            self._made = SF.expr(self.sql)._jc
        return self._made

    __eq__ = _operator("=", "__eq__")
    __ne__ = _operator("<>", "__ne__")
    __lt__ = _operator("<", "__lt__")
    __le__ = _operator("<=", "__le__")
    __gt__ = _operator(">", "__gt__")
    __ge__ = _operator(">=", "__ge__")
    __add__ = _operator("+", "__add__")
    __sub__ = _operator("-", "__sub__")
    __mul__ = _operator("*", "__mul__")
    __mod__ = _operator("%", "__mod__")
    __radd__ = _operator("+", "__radd__", True)
    __rsub__ = _operator("-", "__rsub__", True)
    __rmul__ = _operator("*", "__rmul__", True)
    __and__ = _operator("AND", "__and__")
    __or__ = _operator("OR", "__or__")
    eqNullSafe = _operator("<=>", "eqNullSafe")
    startswith = _call("startswith", "startswith")
    endswith = _call("endswith", "endswith")
    contains = _call("contains", "contains")
    rlike = _call("regexp_like", "rlike")
    __hash__ = None

    def __invert__(self):
        return Text(f"(NOT {self.sql})")

    def __neg__(self):
        return Text(f"(- {self.sql})")

    def __getitem__(self, k):
        return super().__getitem__(k) if isinstance(k, (slice, _Column)) else Text(f"{self.sql}[{_literal(k)}]")

    def isNull(self):
        return Text(f"({self.sql} IS NULL)")

    def isNotNull(self):
        return Text(f"({self.sql} IS NOT NULL)")

    def isin(self, *values):
        values = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values
        try:
            return Text(f"({self.sql} IN ({', '.join(map(_sql, values))}))") if values else super().isin(*values)
        except NotText:
            return super().isin(*values)

    def cast(self, kind):
        return Text(f"CAST({self.sql} AS {kind if isinstance(kind, str) else kind.simpleString()})")

    def alias(self, *names, **more):
        if len(names) != 1 or more:
            return super().alias(*names, **more)
        return Text(f"{self.sql} AS `{names[0]}`")

    def substr(self, start, length):
        try:
            return Text(f"substr({self.sql}, {_sql(start)}, {_sql(length)})")
        except NotText:
            return super().substr(start, length)

    def __repr__(self):
        return f"Text<{self.sql}>"


class _Case(Text):
    """``when`` chains; more arms and an ``otherwise`` may follow."""

    def __init__(self, arms: list[tuple[str, str]]):
        self.arms = arms
        super().__init__("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + " END")

    def when(self, condition, value):
        try:
            return _Case([*self.arms, (_sql(condition), _sql(value))])
        except NotText:
            return _Column.when(self, condition, value)

    def otherwise(self, value):
        try:
            return Text(f"{self.sql[:-4]} ELSE {_sql(value)} END")
        except NotText:
            return _Column.otherwise(self, value)


# Functions whose SQL name and arguments are those of pyspark.sql.functions;
# the numbers are the places of arguments that are plain strings, not names.
_PLAIN = {name: () for name in (
    "aggregate array array_contains array_distinct array_max array_min array_sort btrim char_length coalesce concat element_at exists "
    "filter flatten forall get greatest least length lower map_contains_key map_from_entries map_keys nullif octet_length "
    "regexp_extract_all replace reverse schema_of_variant sequence size slice struct substring transform trim "
    "try_element_at try_make_timestamp_ntz try_parse_json try_to_timestamp upper").split()}
_PLAIN |= {"split": (1,), "regexp_replace": (1, 2), "regexp_extract": (1,), "array_join": (1, 2), "try_variant_get": (1, 2),
           "date_format": (1,), "translate": (1, 2)}


def _lambda(f) -> str:
    names = [f"v{next(_names)}" for _ in inspect.signature(f).parameters]
    body = _sql(f(*map(Text, names)))
    return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {body}"


def _argument(v, plain: bool) -> str:
    if callable(v) and not isinstance(v, _Column):
        return _lambda(v)
    return col(v).sql if isinstance(v, str) and not plain else _sql(v)


def col(name: str):
    if name == "*" or name.endswith(".*"):
        raise NotText
    return Text(name if "`" in name else ".".join(f"`{x}`" for x in name.split(".")))


def _special(name: str, args: tuple) -> Text:
    if name == "lit":
        return args[0] if isinstance(args[0], Text) else Text(_sql(args[0]))
    if name == "col":
        return col(args[0])
    if name == "expr":
        return Text(f"({args[0]})")
    if name == "when":
        return _Case([(_sql(args[0]), _sql(args[1]))])
    if name == "call_function":
        name, args = args[0], args[1:]
    elif name == "create_map":
        name = "map"
    elif name not in _PLAIN:
        raise NotText
    if len(args) == 1 and isinstance(args[0], (list, tuple)):
        args = tuple(args[0])
    plain = _PLAIN.get(name, ())
    return Text(f"{name}({', '.join(_argument(a, i in plain) for i, a in enumerate(args))})")


class _Functions:
    """``pyspark.sql.functions``, as text where it can be."""

    def __getattr__(self, name: str):
        real = getattr(SF, name)

        def call(*args, **more):
            if not more:
                try:
                    return _special(name, args)
                except NotText:
                    pass
            return real(*args, **more)
        setattr(self, name, call)
        return call


F = _Functions()
