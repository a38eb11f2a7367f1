"""Display and identity texts: result ids, titles, labels, URL state."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def result_id(target: Column, case: Column) -> Column:
    """Id of a result's node: RESULT:<target>, with #case if there is one."""
    return F.concat(F.lit("RESULT:"), target, F.when(F.coalesce(case, F.lit("")) != "", F.concat(F.lit("#"), case)).otherwise(""))


def case_of(node_id: Column, target: Column) -> Column:
    """Case of a result: what follows ``#``, else the target if it is a TC: node, else empty."""
    return F.when(F.instr(node_id, "#") > 0, F.substr(node_id, F.instr(node_id, "#") + 1)).when(target.startswith("TC:"), F.substr(target, F.lit(4))).otherwise("")


def schema_title(id_: Column, title: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(id_, F.lit("")), F.nullif(title, F.lit("")))


def document_title(title: Column, schema: Column, directory: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(schema, F.lit("")), directory)


def tier_label(noun: Column, levels: Column, direction: Column) -> Column:
    return F.when(levels == 1, F.concat_ws(" ", F.lit("direct"), direction, noun)).otherwise(F.concat_ws(" ", levels, F.lit("levels"), direction, noun))


def encode_filters(selected: dict[str, list[str]]) -> str:
    """``f=attr:value`` pairs of a URL; the first colon separates."""
    return "&".join(f"f={quote(a, safe='')}:{quote(v, safe='')}" for a in selected for v in selected[a])


def decode_filters(query: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for key, pair in parse_qsl(query.lstrip("?#"), keep_blank_values=True):
        a, colon, v = pair.partition(":")
        if key == "f" and colon and a:
            out.setdefault(a, []).append(v)
    return out


def ordered_properties(required: list[str], properties: list[str], builtins: list[str]) -> list[str]:
    """Required ones in schema order, then the others A to Z, then built-ins that aren't listed yet."""
    out = list(dict.fromkeys(required)) + sorted(set(properties) - set(required))
    return out + [b for b in builtins if b not in out]


def format_scalar(value: Column, kind: Column) -> Column:
    """An attribute for display: texts plain, numbers without an exponent, lists and maps as compact JSON, null as nothing.

    ``value`` is the value as text, ``kind`` its variant type.
    """
    number = F.regexp_replace(F.format_string("%.15f", value.try_cast("double")), r"\.?0+$", "")
    plain = F.when(kind.rlike("^(DOUBLE|FLOAT)") & value.rlike("[eE]"), number).when(kind.startswith("DOUBLE"), F.regexp_replace(value, r"\.0$", "")).otherwise(value)
    return F.coalesce(plain, F.lit(""))


def attribute_label(name: Column) -> Column:
    """Words of an attribute's name, the first letter large."""
    words = F.regexp_replace(name, "[-_]+", " ")
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))


def relative_link(from_page: Column, to_page: Column, anchor: Column) -> Column:
    """Link from one page to an anchor of another, both paths from the root: up to the root, then down; the anchor alone within a page."""
    up = F.repeat(F.lit("../"), F.size(F.split(from_page, "/")) - 1)
    return F.when(from_page == to_page, F.concat(F.lit("#"), anchor)).otherwise(F.concat(up, to_page, F.lit("#"), anchor))
