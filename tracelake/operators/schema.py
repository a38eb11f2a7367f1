"""JSON Schema (2020-12) over attributes: schemas compile to Columns that list every violation with its path.

A requirement's attributes are one object variant; keywords apply recursively,
inside lists and maps by higher-order functions, so a schema of any shape is
one expression and the nodes are read once. ``problems`` says what of a schema
can't be used; the rest of it still counts.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import refs as R
from tracelake.model import Model

#: Attributes that every schema has without declaring them, with their rules (fixed values of the format).
BUILTINS: dict[str, dict] = {
    "trace": {"type": "array", "items": {"type": "string", "pattern": R.TRACE_ITEM}},
    "disposition": {"type": "string", "enum": ["implemented", "deferred", "rejected"]},
    "disposition-reason": {"type": "string"},
    "requires-trace-from": {"type": "array", "items": {"type": "string", "pattern": "^[a-z0-9_-]+$"}},
    "version": {"type": "integer"},
    "status": {"type": "string", "enum": ["draft", "approved"]},
}
#: Columns of the nodes that hold attributes, by attribute.
COLUMNS = {"status": "status", "verify": "verify", "disposition": "disposition", "disposition-reason": "disposition_reason", "version": "version", "trace": "trace", "requires-trace-from": "requires_trace_from", "id": "id", "title": "title"}
DEPTH = 8  # nested references followed; a value nested deeper is a violation
_ERRORS = "array<struct<attr: string, problem: string>>"
_NUMBER = "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"
_TYPES = {"string": "^STRING", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID", "number": _NUMBER, "integer": _NUMBER}
#: Texts that ``format`` accepts, where formats are asserted; other formats are annotations.
FORMATS = {
    "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)([.][0-9]+)?([zZ]|[+-][0-9]{2}:[0-9]{2})$",
    "date-time": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[tT ]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)([.][0-9]+)?([zZ]|[+-][0-9]{2}:[0-9]{2})$",
    "email": r"^[^@\s]+@[^@\s]+$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})([.]|$)){4}(?<![.])$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$",
    "uuid": r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
}
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format", "contentEncoding", "contentMediaType", "contentSchema", "$schema", "$id", "$comment", "$anchor", "$vocabulary", "$defs", "definitions"}


# ------------------------------------------------------------ what can't be used


def _count(v: object) -> str:
    return "" if isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0 and v == int(v) else "must be a whole number"


def _number(v: object) -> str:
    return "" if isinstance(v, (int, float)) and not isinstance(v, bool) else "must be a number"


def _names(v: object) -> str:
    return "" if isinstance(v, list) and all(isinstance(x, str) for x in v) else "must be a list of texts"


def _type(v: object) -> str:
    odd = [x for x in (v if isinstance(v, list) else [v]) if x not in _TYPES]
    return f"unknown type {odd[0]!r}" if odd else ""


def _pattern(v: object) -> str:
    if not isinstance(v, str):
        return "must be a text"
    spark = SparkSession.getActiveSession()
    if spark is None:
        return ""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(v)
    except Exception:
        return f"not a regular expression: {v!r}"
    return ""


#: What each keyword's own value must be.
_VALUES = {
    "type": _type, "enum": lambda v: "" if isinstance(v, list) else "must be a list", "const": lambda v: "", "pattern": _pattern, "required": _names,
    **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems", "minContains", "maxContains", "minProperties", "maxProperties"), _count),
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), _number),
    "multipleOf": lambda v: _number(v) or ("" if v > 0 else "must be over 0"), "uniqueItems": lambda v: "" if isinstance(v, bool) else "must be true or false",
    "dependentRequired": lambda v: "" if isinstance(v, dict) and not any(map(_names, v.values())) else "must map names to lists of texts",
}
_ONE = ("items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else")
_LISTED = ("allOf", "anyOf", "oneOf", "prefixItems")
_NAMED = ("properties", "patternProperties", "dependentSchemas")


def _looked_up(root: object, ref: object) -> object:
    """The schema that a local reference names, or None."""
    if not isinstance(ref, str) or not ref.startswith("#"):
        return None
    at = root
    for step in ref[1:].split("/")[1:] if ref != "#" else []:
        step = step.replace("~1", "/").replace("~0", "~")
        at = at.get(step) if isinstance(at, dict) else at[int(step)] if isinstance(at, list) and step.isdigit() and int(step) < len(at) else None
    return at if isinstance(at, (dict, bool)) else None


def problems(schema: object, at: str = "", root: object = None) -> list[str]:
    """What of a schema is malformed or unknown, with its place; none for a good one."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return []
    if not isinstance(schema, dict):
        return [f"{at or '#'}: must be a map"]
    out = []
    for k, v in schema.items():
        here = f"{at}/{k}"
        if k in _VALUES:
            out += [f"{here}: {said}"] if (said := _VALUES[k](v)) else []
        elif k == "$ref":
            out += [] if _looked_up(root, v) is not None else [f"{here}: {v!r} names no schema here"]
        elif k in _ONE:
            out += problems(v, here, root)
        elif k in _LISTED:
            out += [p for i, x in enumerate(v) for p in problems(x, f"{here}/{i}", root)] if isinstance(v, list) else [f"{here}: must be a list"]
        elif k in (*_NAMED, "$defs", "definitions"):
            if not isinstance(v, dict):
                out.append(f"{here}: must be a map")
                continue
            out += [p for n, x in v.items() for p in problems(x, f"{here}/{n}", root)]
            out += [f"{here}/{n}: {said}" for n in v if k == "patternProperties" and (said := _pattern(n))]
        elif k not in _NOTES and not k.startswith("x-"):
            out.append(f"{here}: unknown keyword")
    if not at:
        own = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        for a in sorted(own.keys() & BUILTINS.keys()):
            if isinstance(own[a], dict) and own[a].get("type", BUILTINS[a]["type"]) != BUILTINS[a]["type"]:
                out.append(f"/properties/{a}: declared again as another type")
    return out


# ------------------------------------------------------------ compilation


def _none() -> Column:
    return F.array().cast(_ERRORS)


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _below(path: Column | None, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return name if path is None else F.concat(path, F.lit("."), name)


def _member(v: Column, name: str) -> Column:
    escaped = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(v, f'$["{escaped}"]', "variant")


def _same(v: Column, value: object) -> Column:
    """Whether a variant is the JSON value; numbers inside lists and maps must be written alike."""
    kind = F.schema_of_variant(v)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return kind.rlike(_NUMBER) & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    return kind == "VOID" if value is None else F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


class _Compiler:
    def __init__(self, root: dict, formats: bool):
        self.root, self.formats = root, formats

    def valid(self, s: object, v: Column, depth: int) -> Column:
        return F.size(self.errors(s, v, None, depth)) == 0

    def errors(self, s: object, v: Column, path: Column | None, depth: int = 0) -> Column:
        """The violations of a value that is there, as an array of (attr, problem); keywords that ``problems`` names are left out."""
        here = F.lit("") if path is None else path

        def one(bad: Column, problem: str, at: Column = here) -> Column:
            return F.when(bad, F.array(F.struct(at.alias("attr"), F.lit(problem).alias("problem")))).otherwise(_none())

        if isinstance(s, bool) or not isinstance(s, dict):
            return one(F.lit(s is False), "false")
        kind = F.schema_of_variant(v)
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        is_text, is_number, is_list, is_map = kind == "STRING", kind.rlike(_NUMBER), kind.startswith("ARRAY"), kind.startswith("OBJECT")
        items = F.when(is_list, F.try_variant_get(v, "$", "array<variant>"))
        entries = F.when(is_map, F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
        use = {k: x for k, x in s.items() if not (k in _VALUES and _VALUES[k](x)) and not (k in _LISTED and not isinstance(x, list)) and not (k in _NAMED and not isinstance(x, dict))}
        parts: list[Column] = []
        for k, x in use.items():
            if k == "type":
                fits = [kind.rlike(_TYPES[t]) & ((number == F.floor(number)) if t == "integer" else F.lit(True)) for t in (x if isinstance(x, list) else [x])]
                parts.append(one(~F.coalesce(reduce(or_, fits, F.lit(False)), F.lit(False)), k))
            elif k in ("enum", "const"):
                parts.append(one(~F.coalesce(reduce(or_, (_same(v, y) for y in (x if k == "enum" else [x])), F.lit(False)), F.lit(False)), k))
            elif k == "pattern":
                parts.append(one(is_text & ~text.rlike(x), k))
            elif k in ("minLength", "maxLength"):
                parts.append(one(is_text & ((F.length(text) < int(x)) if k == "minLength" else (F.length(text) > int(x))), k))
            elif k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                bad = {"minimum": number < x, "maximum": number > x, "exclusiveMinimum": number <= x, "exclusiveMaximum": number >= x}[k]
                parts.append(one(is_number & bad, k))
            elif k == "multipleOf":
                parts.append(one(is_number & (F.abs(number / F.lit(float(x)) - F.round(number / F.lit(float(x)))) > 1e-9), k))
            elif k == "format" and self.formats and x in FORMATS:
                parts.append(one(is_text & ~text.rlike(FORMATS[x]), k))
            elif k in ("minItems", "maxItems"):
                parts.append(one((F.size(items) < int(x)) if k == "minItems" else (F.size(items) > int(x)), k))
            elif k == "uniqueItems" and x:
                parts.append(one(F.size(F.array_distinct(F.transform(items, lambda e: F.to_json(e)))) < F.size(items), k))
            elif k in ("minProperties", "maxProperties"):
                parts.append(one((F.size(entries) < int(x)) if k == "minProperties" else (F.size(entries) > int(x)), k))
            elif k == "required":
                parts += [one(is_map & _member(v, n).isNull(), k, _below(path, n)) for n in x]
            elif k == "dependentRequired":
                parts += [one(is_map & _member(v, n).isNotNull() & _member(v, y).isNull(), k, _below(path, y)) for n, own in x.items() for y in own]
            elif k == "dependentSchemas":
                parts += [F.when(is_map & _member(v, n).isNotNull(), self.errors(y, v, path, depth)).otherwise(_none()) for n, y in x.items()]
            elif k == "properties":
                parts += [F.when(is_map & _member(v, n).isNotNull(), self.errors(y, _member(v, n), _below(path, n), depth)).otherwise(_none()) for n, y in x.items()]
            elif k == "patternProperties":
                parts += [self._entries(entries, lambda e: e["key"].rlike(p), y, path, depth) for p, y in x.items() if not _pattern(p)]
            elif k == "additionalProperties":
                known, like = list(use.get("properties") or {}), [p for p in use.get("patternProperties") or {} if not _pattern(p)]
                extra = lambda e: ~(reduce(or_, (e["key"].rlike(p) for p in like), e["key"].isin(known) if known else F.lit(False)))  # noqa: E731, B023
                if x is False:
                    said = lambda e: F.struct(_below(path, e["key"]).alias("attr"), F.lit("additionalProperties").alias("problem"))
                    parts.append(F.coalesce(F.transform(F.filter(entries, extra), said), _none()))
                else:
                    parts.append(self._entries(entries, extra, x, path, depth))
            elif k == "propertyNames":
                parts.append(one(F.exists(entries, lambda e: ~self.valid(x, e["key"].cast("variant"), depth)), k))  # noqa: B023
            elif k == "prefixItems":
                parts += [F.when(F.get(items, F.lit(i)).isNotNull(), self.errors(y, F.get(items, F.lit(i)), F.concat(here, F.lit(f"[{i}]")), depth)).otherwise(_none()) for i, y in enumerate(x)]
            elif k == "items":
                first = len(use.get("prefixItems") or ())
                each = lambda e, i: F.when(i >= first, self.errors(x, e, F.concat(here, F.lit("["), i.cast("string"), F.lit("]")), depth)).otherwise(_none())  # noqa: E731, B023
                parts.append(F.coalesce(F.flatten(F.transform(items, each)), _none()))
            elif k == "contains":
                n = F.size(F.filter(items, lambda e: self.valid(x, e, depth)))  # noqa: B023
                least, most = int(use.get("minContains", 1)), use.get("maxContains")
                parts.append(one(is_list & ((n < least) if most is None else (n < least) | (n > int(most))), k))
            elif k == "allOf":
                parts += [self.errors(y, v, path, depth) for y in x]
            elif k in ("anyOf", "oneOf"):
                n = reduce(lambda a, b: a + b, (self.valid(y, v, depth).cast("int") for y in x), F.lit(0))
                parts.append(one((n == 0) if k == "anyOf" else (n != 1), k))
            elif k == "not":
                parts.append(one(self.valid(x, v, depth), k))
            elif k == "if":
                then, other = (self.errors(use[b], v, path, depth) if b in use else _none() for b in ("then", "else"))
                parts.append(F.when(self.valid(x, v, depth), then).otherwise(other))
            elif k == "$ref" and (there := _looked_up(self.root, x)) is not None:
                parts.append(one(F.lit(True), "nested too deeply") if depth == DEPTH else self.errors(there, v, path, depth + 1))
        return _joined(parts)

    def _entries(self, entries: Column, which, s: object, path: Column | None, depth: int) -> Column:  # noqa: ANN001
        return F.coalesce(F.flatten(F.transform(F.filter(entries, which), lambda e: self.errors(s, e["value"], _below(path, e["key"]), depth))), _none())


def whole(schema: dict) -> dict:
    """The schema with the built-in attributes; their rules also hold for those that it declares itself. Status values that its extensions add are allowed."""
    own = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    more = [x for k, e in schema.items() if k.startswith("x-") and isinstance(e, dict) and isinstance(e.get("additional-status-values"), list) for x in e["additional-status-values"] if isinstance(x, str)]
    rules = BUILTINS | {"status": BUILTINS["status"] | {"enum": [*BUILTINS["status"]["enum"], *more]}}
    odd = {a for a in own.keys() & rules.keys() if isinstance(own[a], dict) and own[a].get("type", rules[a]["type"]) != rules[a]["type"]}
    merged = {a: rules[a] if a not in own or a in odd else {"allOf": [rules[a], own[a]]} for a in rules}
    return {**schema, "properties": {"id": True, "title": True, **own, **merged}}


def violations(schema: dict, instance: Column, formats: bool = False) -> Column:
    """An array of (attr, problem): what of an object variant breaks the schema; equal ones once."""
    rules = whole(schema)
    return F.array_distinct(_Compiler(rules, formats).errors(rules, instance, None))


def instance(columns: list[str], named: bool = False) -> Column:
    """A node's attributes as one object variant: its columns and the members of ``attrs``; ``named``: id and title, too."""
    value = {a: F.nullif(F.col(c), F.lit(0)) if a == "version" else F.col(c) for a, c in COLUMNS.items() if c in columns and (named or a not in ("id", "title"))}
    fixed = F.array(*(F.struct(F.lit(a).alias("key"), c.cast("variant").alias("value")) for a, c in value.items())) if value else F.array().cast("array<struct<key: string, value: variant>>")
    if "attrs" not in columns:
        return F.to_variant_object(F.map_from_entries(F.filter(fixed, lambda e: e["value"].isNotNull())))
    more = F.coalesce(F.map_entries(F.try_variant_get(F.try_parse_json("attrs"), "$", "map<string,variant>")), F.array().cast("array<struct<key: string, value: variant>>"))
    keys = F.coalesce(F.json_object_keys("attrs"), F.array().cast("array<string>"))
    return F.to_variant_object(F.map_from_entries(F.concat(F.filter(fixed, lambda e: e["value"].isNotNull() & ~F.array_contains(keys, e["key"])), more)))


def schema_errors(m: Model, schemas: dict[str, dict], formats: bool = False) -> DataFrame:
    """doc_path, id, attr, problem for each violation of a document's schema; one pass over the nodes.

    ``attr`` is the path of the value, as in ``tags[1]`` or ``owner.name``.
    Documents whose schemas say the same share one compiled expression.
    """
    by: dict[str, list[str]] = {}
    for d, s in schemas.items():
        by.setdefault(json.dumps(s, sort_keys=True, default=str), []).append(d)
    if not by:
        return m.nodes.limit(0).select("doc_path", "id", F.lit("").alias("attr"), F.lit("").alias("problem"))
    named = any(a in json.dumps(s, default=str) for s in schemas.values() for a in ('"id"', '"title"'))
    x = m.nodes.filter("kind = 'req'").select("doc_path", "id", instance(m.nodes.columns, named).alias("_v"))
    found = reduce(lambda acc, kd: acc.when(F.col("doc_path").isin(kd[1]), violations(json.loads(kd[0]), F.col("_v"), formats)), list(by.items()), F.when(F.lit(False), _none())).otherwise(_none())
    return x.select("doc_path", "id", F.explode(found).alias("e")).select("doc_path", "id", "e.attr", "e.problem")
