"""Requirement Markdown: one file's text to an ordered list of blocks.

A line-based block reader: ATX headings, fenced code, thematic breaks,
paragraphs, and everything else (lists, quotes, tables) kept as written. A
heading followed directly by an ``attr`` fence is a requirement, any other an
info block; level 1 is the document's title only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*?)[ \t]*$")
_BREAK = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_OTHER = re.compile(r" {0,3}(?:[-+*][ \t]|\d{1,9}[.)][ \t]|>|\|)| {4}|\t")
_INLINE = re.compile(r"(\*\*|__|\*|`)(.+?)\1")
_KEY = re.compile(r"([^\s:#'\"\[\]{}][^:]*?):(?:[ \t]+(.*))?$")


class MarkdownError(ValueError):
    pass


class _Loader(yaml.SafeLoader):
    """Only ``true``/``false`` spellings are booleans; dates stay as they are read."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


@dataclass
class Block:
    level: int
    kind: str
    id: str = ""
    title: str = ""
    body: str = ""
    rationale: str = ""
    attrs: dict = field(default_factory=dict)
    suppressions: list[str] = field(default_factory=list)


def load_yaml(text: str) -> object:
    return yaml.load(text, _Loader)  # noqa: S506  a SafeLoader


def _mapping(text: str, where: str) -> dict:
    try:
        out = load_yaml(text) or {}
    except yaml.YAMLError as e:
        raise MarkdownError(f"{where}: {e}") from e
    if not isinstance(out, dict):
        raise MarkdownError(f"{where}: a map is expected")
    return out


class Unreadable(dict):
    """An empty schema in place of one that can't be read; ``error`` says why."""

    def __init__(self, error: str):
        super().__init__()
        self.error = error


def load_schema(text: str) -> dict:
    """A schema file's map, or an ``Unreadable`` one."""
    try:
        return _mapping(text, "schema.yaml")
    except MarkdownError as e:
        return Unreadable(str(e))


def decode_attrs(text: str) -> dict:
    """A flat block: scalars, lists and flow values; nested block maps, repeated keys and list items at the margin are errors."""
    seen, open_key = set(), None
    for line in text.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] in " \t":
            item = line.strip()
            if open_key is None:
                raise MarkdownError(f"unexpected indent: {line!r}")
            if open_key == "" and not item.startswith("- ") and item != "-":
                raise MarkdownError(f"nested block maps aren't allowed: {line!r}")
            continue
        if line.startswith("- "):
            raise MarkdownError(f"list items must be indented: {line!r}")
        m = _KEY.match(line)
        if not m:
            raise MarkdownError(f"key expected: {line!r}")
        if m[1] in seen:
            raise MarkdownError(f"repeated key {m[1]!r}")
        seen.add(m[1])
        open_key = (m[2] or "").split(" #")[0].strip()
    try:
        out = load_yaml(text) or {}
    except yaml.YAMLError as e:
        raise MarkdownError(str(e)) from e
    if not isinstance(out, dict):
        raise MarkdownError("a map is expected")
    return {str(k): v for k, v in out.items()}


def split_heading(heading: str) -> tuple[str, str]:
    head, _, tail = heading.partition(": ")
    return head.strip(), tail.strip()


def inline_text(s: str) -> str:
    before = None
    while before != s:
        before, s = s, _INLINE.sub(r"\2", s)
    return re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)


def _blocks(lines: list[str]):
    """(kind, data) of each block in order."""
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            end, body = m[1], []
            i += 1
            while i < n and not re.match(rf" {{0,3}}{re.escape(end[0])}{{{len(end)},}}[ \t]*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            yield "fence", (m[2].split()[0] if m[2].split() else "", "\n".join(body), end)
        elif m := _HEADING.match(line):
            yield "heading", (len(m[1]), inline_text((m[2] or "").strip()))
            i += 1
        elif _BREAK.match(line):
            yield "break", None
            i += 1
        elif _OTHER.match(line):
            start = i
            while i < n and lines[i].strip() and not _HEADING.match(lines[i]) and not _FENCE.match(lines[i]):
                i += 1
            yield "other", "\n".join(lines[start:i])
        else:
            start = i
            while i < n and lines[i].strip() and not (i > start and (_HEADING.match(lines[i]) or _FENCE.match(lines[i]) or _BREAK.match(lines[i]) or re.match(r" {0,3}(?:[-+*][ \t]|>)", lines[i]))):
                i += 1
            yield "paragraph", "".join(x.strip() for x in lines[start:i]).strip()


def split_roots(text: str, most: int = 1 << 18) -> list[str]:
    """A large document in parts of about ``most`` characters that parse one by one to the same blocks: cut before level-2 requirements only.

    A heading counts if it stands outside fences and an ``attr`` fence follows.
    """
    if len(text) < most:
        return [text]
    lines, parts, begin, size, fence = text.replace("\r\n", "\n").split("\n"), [], 0, 0, ""
    first = next((i for i in range(1, len(lines)) if lines[i].rstrip() == "---"), 0) if lines[0].rstrip() == "---" else 0
    for i, line in enumerate(lines):
        if i > first and not fence and size >= most and re.match(r"## \S", line):
            nxt = next((x for x in lines[i + 1 : i + 50] if x.strip()), "")
            if re.match(r" {0,3}(?:`{3,}|~{3,})[ \t]*attr[ \t]*$", nxt) and not lines[i - 1].strip():
                parts.append("\n".join(lines[begin:i]))
                begin, size = i, 0
        size += len(line) + 1
        if i > first and (m := re.match(r" {0,3}(`{3,}|~{3,})", line)):
            if not fence:
                fence = m[1]
            elif m[1].startswith(fence[0] * len(fence)) and not line.strip().strip(fence[0]):
                fence = ""
    return [*parts, "\n".join(lines[begin:])]


def parse(text: str, path: str = "", tool: str | None = None) -> tuple[list[Block], str, dict]:
    """(blocks in order, title, frontmatter). Suppressions are the list under ``<tool>-suppress``; without ``tool``, under the only key that ends so."""
    lines = text.replace("\r\n", "\n").split("\n")
    front: dict = {}
    if lines and lines[0].rstrip() == "---":
        for i in range(1, len(lines)):
            if lines[i].rstrip() == "---":
                front = _mapping("\n".join(lines[1:i]), f"{path}: frontmatter")
                lines = lines[i + 1 :]
                break
    out: list[Block] = []
    title, cur, waiting, body = "", None, False, ""

    def open_() -> Block:
        nonlocal cur
        if cur is None:
            cur = Block(0, "info")
            out.append(cur)
        return cur

    def close() -> None:
        nonlocal cur, body
        if cur is not None:
            cur.body = body
        cur, body = None, ""

    blocks = list(_blocks(lines))
    for k, (kind, data) in enumerate(blocks):
        if kind == "heading":
            level, heading = data
            is_req = k + 1 < len(blocks) and blocks[k + 1][0] == "fence" and blocks[k + 1][1][0] == "attr"
            if level == 1:
                if is_req:
                    raise MarkdownError(f"{path}: heading {heading!r} is a level-1 requirement")
                close()
                waiting = False
                title = title or heading.strip()
                continue
            close()
            cur = Block(level, "req", *split_heading(heading)) if is_req else Block(level, "info", title=heading)
            out.append(cur)
            waiting = is_req
        elif kind == "fence" and cur is not None and waiting and data[0] == "attr":
            try:
                cur.attrs = decode_attrs(data[1])
            except MarkdownError as e:
                raise MarkdownError(f"{path}: {cur.id}: {e}") from e
            keys = [x for x in cur.attrs if (x.endswith("-suppress") if tool is None else x == f"{tool}-suppress")]
            if len(keys) > 1:
                raise MarkdownError(f"{path}: {cur.id}: {', '.join(keys)}: name the tool")
            for key in keys:
                value = cur.attrs.pop(key)
                cur.suppressions = [s for s in value if isinstance(s, str)] if isinstance(value, list) else []
            waiting = False
        elif kind == "paragraph" and data.startswith("*Rationale:"):
            open_().rationale = data.removeprefix("*Rationale:").lstrip("* ").strip().removesuffix("*").strip()
        elif kind in ("paragraph", "break"):
            open_()
            if data != "":
                body += ("\n\n" if body else "") + (data if kind == "paragraph" else "---")
        else:
            open_()
            body += ("\n\n" if body else "") + (f"{data[2]}{data[0]}\n{data[1]}\n{data[2]}" if kind == "fence" else data)
    close()
    return out, title, front
