"""Exchange bundles to Markdown documents: guards, ids, parents before children."""

from __future__ import annotations

import re

from tracelake.sources import sinks

MARKER = "generated"
_ATTR_KEY = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*")


def guard(documents: list[dict]) -> list[str]:
    """What forbids rendering a bundle's documents; empty if nothing does."""
    bad, seen = [], set()
    for d in documents:
        path = f"{d.get('dir', '')}/{d.get('file') or 'requirements.md'}"
        if d.get("dir", "").startswith("/") or ".." in d.get("dir", "").split("/"):
            bad.append(f"{path}: leaves the target directory")
        if re.search(r"[/\\]", d.get("file") or ""):
            bad.append(f"{path}: not a plain file name")
        if path in seen:
            bad.append(f"{path}: written twice")
        seen.add(path)
        for r in d.get("requirements", []):
            who = r.get("native-id", "")
            if re.search(r"\s", f"{d.get('id-prefix', '')}{who}"):
                bad.append(f"{who}: white space in an id")
            if "\n" in r.get("title", ""):
                bad.append(f"{who}: title of several lines")
            if re.search(r"(?m)^#{1,6} .*\n+```attr", r.get("body", "")) or re.match(r"\s*```attr", r.get("body", "")):
                bad.append(f"{who}: attribute fence in the body")
            bad += [f"{who}: attribute name {k!r}" for k in r.get("attrs", {}) if not _ATTR_KEY.fullmatch(k)]
    return bad


def by_depth(items: list[dict]) -> list[dict]:
    """Children after their parents, in order, with ``depth``; a cycle is an error."""
    own = {r["native-id"]: r for r in items}
    below: dict[str, list[dict]] = {}
    for r in items:
        below.setdefault(r.get("parent") if r.get("parent") in own else "", []).append(r)
    out, stack = [], [(r, 0) for r in reversed(below.get("", []))]
    while stack:
        r, depth = stack.pop()
        out.append(r | {"depth": depth})
        stack += [(c, depth + 1) for c in reversed(below.get(r["native-id"], []))]
    if len(out) < len(items):
        raise ValueError(f"parents form a cycle: {sorted(set(own) - {r['native-id'] for r in out})}")
    return out


def build(documents: list[dict]) -> dict[str, str]:
    """Path to text of every document; native references become ids with their document's prefix."""
    if bad := guard(documents):
        raise ValueError("; ".join(bad))
    ids = {r["native-id"]: f"{d['id-prefix']}{r['native-id']}" for d in documents for r in d.get("requirements", [])}
    out = {}
    for d in documents:
        items = [{"id": ids[r["native-id"]], "title": r.get("title", ""), "body": r.get("body", ""), "status": r.get("status", ""), "depth": r["depth"], "trace": [*r.get("trace", []), *(ids[n] for n in r.get("native-trace", []))], "attrs": r.get("attrs", {})} for r in by_depth(d.get("requirements", []))]
        out[f"{d.get('dir') or '.'}/{d.get('file') or 'requirements.md'}"] = sinks.markdown(d.get("title") or "Imported requirements", d.get("notice") or MARKER, items)
    return out
