"""Filter expressions compiled to Columns.

Grammar: ``or``/``||``, ``and``/``&&``, ``not``/``!``, comparisons (== != < <=
> >=, ``in``, ``not in``, ``startsWith``, ``endsWith``, ``contains``,
``matches``), literals (strings, numbers, true, false, nil, lists), names, and
the calls len, all, any, none, one, filter, map, count, find with a predicate
in braces where ``#`` is the element. A missing attribute is nil: equality
is null-safe, membership false, ordered comparison with nil an error.

Names are columns, or members of the JSON text ``attrs``. Members are variants:
each value keeps the type that it has, what it is compared with says as what it
is taken, and a value of another type equals nothing but is an error to order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>==|!=|<=|>=|&&|\|\||[<>!()\[\]{},#.])|(?P<name>[A-Za-z_][A-Za-z0-9_-]*))""")
CALLS = ("len", "all", "any", "none", "one", "filter", "map", "count", "find")
WORDS = ("contains", "startsWith", "endsWith", "matches", "in", "and", "or", "not", "true", "false", "nil")


#: Attributes that every requirement may be asked for (fixed values of the format), and columns that hold attributes.
BUILTIN = {"id", "title", "status", "disposition", "trace", "version"}
_COLUMN_OF = {"disposition-reason": "disposition_reason", "requires-trace-from": "requires_trace_from"}
_FIXED = {"id", "title", "status", "version", "verify", "disposition", "disposition_reason", "trace", "requires_trace_from"}


class ExpressionError(ValueError):
    pass


def _kind(d: T.DataType) -> str:
    kinds = ((T.StringType, "str"), (T.NumericType, "num"), (T.BooleanType, "bool"), (T.ArrayType, "list"), (T.VariantType, "variant"))
    return next((k for t, k in kinds if isinstance(d, t)), "any")


@dataclass
class Value:
    column: Column
    kind: str  # bool, num, str, list, nil, variant, any
    null: bool = True  # may be nil
    items: list[Value] | None = None  # of a list literal
    element: str = "any"  # kind of a list's elements

    def is_nil(self) -> Column:
        return self.column.isNull() | F.is_variant_null(self.column) if self.kind == "variant" else self.column.isNull()

    def of(self, kind: str) -> Column:
        """The value taken as a kind; of a variant, null if it has another."""
        if self.kind != "variant" or kind == "variant":
            return self.column
        pattern, to = _TAKEN[kind]
        return F.when(F.schema_of_variant(self.column).rlike(pattern), F.try_variant_get(self.column, "$", to))


#: By kind, what a variant's own type must be and what it is taken as.
_TAKEN = {"str": ("^STRING", "string"), "num": ("^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "double"), "bool": ("^BOOLEAN", "boolean"), "list": ("^ARRAY", "array<variant>")}


def _equal(x: Value, y: Value) -> Column:
    """Whether two values are equal, nil only to nil; values of different kinds aren't."""
    kinds = {x.kind, y.kind}
    if "nil" in kinds:
        return y.is_nil() if x.kind == "nil" else x.is_nil()
    if "variant" not in kinds:
        return F.lit(False) if len(kinds) > 1 and "any" not in kinds else x.column.eqNullSafe(y.column)
    if kinds <= {"variant", "list"}:
        same = F.to_json(x.column) == F.to_json(y.column)
    elif "any" in kinds:
        same = x.of("str") == y.of("str")
    else:
        kind = (kinds - {"variant"}).pop()
        same = x.of(kind) == y.of(kind)
    return F.when(x.is_nil() | y.is_nil(), x.is_nil() & y.is_nil()).otherwise(F.coalesce(same, F.lit(False)))


class Filter:
    """A compiled expression: ``column`` (boolean), the attributes it names, and warnings about unknown ones.

    Without ``declared``, names are the columns and ``known``, which are nil.
    With it, exactly the built-in names and the declared ones may be named:
    others are an error or, if ``relaxed``, a warning, and are looked up in
    ``attrs`` all the same.
    """

    def __init__(self, text: str, schema: T.StructType, relaxed: bool = False, known: set[str] | None = None, declared: set[str] | None = None):
        self.text, self.schema, self.relaxed, self.declared = text, {f.name: f.dataType for f in schema.fields}, relaxed, declared
        self.known = self.schema.keys() | (known or set())
        self.refs: list[str] = []
        self.warnings: list[str] = []
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ExpressionError(f"unexpected character at {at} in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.element = 0, []
        value = self._or()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r} in {text!r}")
        if value.kind not in ("bool", "any", "variant"):
            raise ExpressionError(f"{text!r} isn't a condition")
        self.column = self._bool(value)

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def _take(self, *what: str) -> str | None:
        if self._peek() in what and what:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, what: str) -> None:
        if not self._take(what):
            raise ExpressionError(f"{what!r} expected in {self.text!r}")

    def _or(self) -> Value:
        x = self._and()
        while self._take("or", "||"):
            x = Value(self._bool(x) | self._bool(self._and()), "bool", False)
        return x

    def _and(self) -> Value:
        x = self._not()
        while self._take("and", "&&"):
            x = Value(self._bool(x) & self._bool(self._not()), "bool", False)
        return x

    def _not(self) -> Value:
        if self._take("not", "!"):
            return Value(~self._bool(self._not()), "bool", False)
        return self._compare()

    def _bool(self, v: Value) -> Column:
        if v.kind not in ("bool", "any", "variant"):
            raise ExpressionError(f"a condition is expected in {self.text!r}")
        return F.coalesce(v.of("bool").cast("boolean"), F.lit(False))

    def _compare(self) -> Value:
        x = self._primary()
        negate = False
        if self._peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
            self.at += 1
            negate = True
        op = self._take("==", "!=", "<", "<=", ">", ">=", "in", "startsWith", "endsWith", "contains", "matches")
        if not op:
            return x
        y = self._primary()
        if op in ("==", "!="):
            same = _equal(x, y)
            return Value(same if op == "==" else ~same, "bool", False)
        if op == "in":
            if y.kind not in ("list", "nil", "any", "variant"):
                raise ExpressionError(f"a list is expected after in: {self.text!r}")
            found = self._member(x, y)
            return Value(~found if negate else found, "bool", False)
        if op in ("startsWith", "endsWith", "contains", "matches"):
            if "str" not in (x.kind, y.kind) and not {"any", "variant"} & {x.kind, y.kind}:
                raise ExpressionError(f"{op} needs texts: {self.text!r}")
            f = {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains, "matches": F.rlike}[op]
            return Value(self._guard(x, y, f(x.of("str"), y.of("str")), op, "str"), "bool", False)
        if x.kind != y.kind and not {"any", "variant"} & {x.kind, y.kind}:
            raise ExpressionError(f"{x.kind} {op} {y.kind} can't be compared: {self.text!r}")
        order = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
        if x.kind == y.kind == "variant":  # numbers or texts, as they are
            both = F.when(x.of("num").isNotNull() & y.of("num").isNotNull(), order(x.of("num"), y.of("num"))).otherwise(order(x.of("str"), y.of("str")))
            return Value(F.coalesce(both, self._error(op)), "bool", False)
        kind = y.kind if x.kind in ("variant", "any") else x.kind
        kind = "str" if kind in ("any", "nil") else kind
        return Value(self._guard(x, y, order(x.of(kind), y.of(kind)), op, kind), "bool", False)

    def _member(self, x: Value, y: Value) -> Column:
        if y.kind == "nil":
            return F.lit(False)
        if y.items is not None and "variant" in {x.kind, *(i.kind for i in y.items)}:
            return reduce(or_, (_equal(x, i) for i in y.items), F.lit(False))
        if y.kind == "variant" or y.element == "variant":
            return F.coalesce(F.exists(y.of("list"), lambda e: _equal(Value(e, "variant"), x)), F.lit(False))
        return F.coalesce(F.array_contains(y.column, x.of(y.element if y.element in _TAKEN else "str")), F.lit(False))

    def _error(self, op: str) -> Column:
        return F.raise_error(F.lit(f"{op} with nil or a value of another type in {self.text!r}")).cast("boolean")

    def _guard(self, x: Value, y: Value, c: Column, op: str, kind: str) -> Column:
        if not (x.null or y.null):
            return c
        return F.when(x.of(kind).isNull() | y.of(kind).isNull(), self._error(op)).otherwise(c)

    def _primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise ExpressionError(f"{self.text!r} ends too soon")
        kind, t = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Value(F.lit(float(t)) if "." in t else F.lit(int(t)), "num", False)
        if kind == "str":
            return Value(F.lit(re.sub(r"\\(.)", r"\1", t[1:-1])), "str", False)
        if t == "(":
            x = self._or()
            self._need(")")
            return x
        if t == "[":
            items: list[Value] = []
            while not self._take("]"):
                items.append(self._primary())
                if not self._take(","):
                    self._need("]")
                    break
            kinds = {i.kind for i in items}
            return Value(F.array(*(i.column for i in items)) if len(kinds) == 1 else F.array(), "list", False, items, kinds.pop() if len(kinds) == 1 else "any")
        if t == "#":
            if not self.element:
                raise ExpressionError(f"# outside a predicate: {self.text!r}")
            return self.element[-1]
        if kind != "name":
            raise ExpressionError(f"unexpected {t!r} in {self.text!r}")
        if t in ("true", "false"):
            return Value(F.lit(t == "true"), "bool", False)
        if t == "nil":
            return Value(F.lit(None), "nil")
        if t in CALLS and self._peek() == "(":
            return self._call(t)
        return self._name(t)

    def _name(self, t: str) -> Value:
        self.refs.append(t)
        own = _COLUMN_OF.get(t, t)
        if self.declared is not None:
            if t not in self.declared | BUILTIN:
                if not self.relaxed:
                    raise ExpressionError(f"unknown attribute {t!r}: no schema declares it")
                self.warnings.append(f"attribute {t!r} is declared by no schema")
            if own not in _FIXED or own not in self.schema:
                return self._attribute(t)
        elif own not in self.schema:
            if t not in self.known and not self.relaxed:
                raise ExpressionError(f"unknown attribute {t!r}")
            self.warnings.append(f"unknown attribute {t!r}")
            return self._attribute(t)
        d = self.schema[own]
        return Value(F.col(f"`{own}`"), _kind(d), element=_kind(d.elementType) if isinstance(d, T.ArrayType) else "any")

    def _attribute(self, t: str) -> Value:
        if "attrs" not in self.schema:
            return Value(F.lit(None), "nil")
        path = t.replace("\\", "\\\\").replace('"', '\\"')
        return Value(F.try_variant_get(F.try_parse_json("attrs"), f'$["{path}"]', "variant"), "variant")

    def _call(self, name: str) -> Value:
        self._need("(")
        x = self._or()
        if name == "len":
            self._need(")")
            n = F.size(x.column) if x.kind == "list" else F.length(x.column) if x.kind != "variant" else F.coalesce(F.when(x.of("list").isNotNull(), F.size(x.of("list"))), F.length(x.of("str")))
            return Value(F.when(F.when(x.is_nil(), None).otherwise(n).isNull(), F.raise_error(F.lit(f"len of nil in {self.text!r}")).cast("int")).otherwise(n), "num", False)
        if x.kind == "variant":
            x = Value(x.of("list"), "list", element="variant")
        if x.kind != "list":
            raise ExpressionError(f"{name} needs a list: {self.text!r}")
        self._need(",")
        brace = self._take("{")
        start = self.at
        kind = {"e": "any"}

        def body(e: Column) -> Column:
            self.at = start
            self.element.append(Value(e, "variant" if x.element == "variant" else "any", x.element == "variant"))
            v = self._or()
            self.element.pop()
            kind["e"] = v.kind
            return v.column if name == "map" else self._bool(v)

        f = {"all": F.forall, "any": F.exists, "none": F.exists, "map": F.transform}.get(name, F.filter)
        empty = F.array().cast(f"array<{'variant' if x.element == 'variant' else 'string'}>")
        out = f(F.coalesce(x.column, empty) if name != "map" else x.column, body)
        if brace:
            self._need("}")
        self._need(")")
        if name in ("all", "any", "none", "one"):
            return Value(~out if name == "none" else F.size(out) == 1 if name == "one" else out, "bool", False)
        if name == "count":
            return Value(F.size(out), "num", False)
        if name == "find":
            return Value(F.get(out, F.lit(0)), "variant" if x.element == "variant" else "any")
        return Value(out, "list", element=kind["e"] if name == "map" else x.element)


def matching_ids(nodes, text: str, relaxed: bool = False, declared: set[str] | None = None):
    """Ids of the requirements that match."""
    return nodes.filter("kind = 'req'").filter(Filter(text, nodes.schema, relaxed, declared=declared).column).select("id").distinct()
