"""Source-code symbols: declarations with their comments, by language, read and parsed on the executors.

Python goes through its own parser. The others are scanned: comments and
strings are blanked, brackets give the depth, and declaration patterns apply
at the depth where the language has them.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import refs as R

SCHEMA = "file string, kind string, name string, receiver string, package string, doc string, start_line int, end_line int, error string"
SKIPPED = (".git", "node_modules", "vendor", ".venv")


@dataclass
class Symbol:
    kind: str
    name: str
    start_line: int
    end_line: int
    receiver: str = ""
    package: str = ""
    doc: str = ""


Parser = Callable[[str, str], list[Symbol]]
_LANGUAGES: dict[str, Parser] = {}


def language(*extensions: str) -> Callable[[Parser], Parser]:
    """Register a parser for file extensions; a second one for the same is an error."""

    def add(f: Parser) -> Parser:
        for e in extensions:
            if e in _LANGUAGES:
                raise ValueError(f"{e} has a parser")
            _LANGUAGES[e] = f
        return f

    return add


def module_name(path: str) -> str:
    return re.split(r"[/\\]", path)[-1].rpartition(".")[0] or re.split(r"[/\\]", path)[-1]


@language(".py")
def python_symbols(path: str, text: str) -> list[Symbol]:
    comments = {t.start[0]: t.string.lstrip("#").strip() for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT and not t.line[: t.start[1]].strip()}

    def doc(node: ast.AST, first: int) -> str:
        lines, at = [], first - 1
        while at in comments:
            lines.append(comments[at])
            at -= 1
        string = ast.get_docstring(node) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        return "\n\n".join(x for x in ("\n".join(reversed(lines)), string) if x)

    out: list[Symbol] = []
    package = module_name(path)

    def visit(body: list[ast.stmt], cls: str) -> None:
        for n in body:
            first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(Symbol("method" if cls else "function", n.name, first, n.end_lineno, cls, package, doc(n, first)))
            elif isinstance(n, ast.ClassDef):
                out.append(Symbol("class", n.name, first, n.end_lineno, "", package, doc(n, first)))
                visit(n.body, n.name)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and not cls:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                        out.append(Symbol("const", t.id, first, n.end_lineno, "", package, doc(n, first)))

    visit(ast.parse(text).body, "")
    return out


_NOISE = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\.)'""", re.S)


def _blank(text: str) -> str:
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _depths(code: str) -> list[int]:
    """Curly depth at the start of each line."""
    out, d = [], 0
    for line in code.split("\n"):
        out.append(d)
        d += line.count("{") - line.count("}")
    return out


def _end(code_lines: list[str], depth: list[int], i: int) -> int:
    """Line (from 1) where the declaration at line index i ends."""
    d, opened = depth[i], False
    for j in range(i, len(code_lines)):
        opened |= "{" in code_lines[j]
        after = depth[j] + code_lines[j].count("{") - code_lines[j].count("}")
        if opened and after <= d or not opened and code_lines[j].rstrip().endswith((";", ")")) and after <= d:
            return j + 1
        if not opened and j > i and not code_lines[j].strip():
            return j
    return len(code_lines)


def clean_comment(line: str) -> str:
    return re.sub(r"^\s*(?:///?!?|/\*\*?|\*/|\*(?!/))\s?|\s*\*/\s*$", "", line).rstrip()


def _doc(lines: list[str], i: int) -> str:
    got = []
    j = i - 1
    while j >= 0 and (re.match(r"\s*(//|/\*|\*)", lines[j]) or lines[j].rstrip().endswith("*/")) or j >= 0 and re.match(r"\s*#\[", lines[j]):
        if not re.match(r"\s*#\[", lines[j]):
            got.append(clean_comment(lines[j]))
        j -= 1
    return "\n".join(reversed(got)).strip("\n")


def _scan(text: str, package: str, rules: list[tuple[int | None, str, re.Pattern]], owner: re.Pattern | None = None) -> list[Symbol]:
    """Rules (depth or any, kind, pattern with a name group and maybe receiver); ``owner`` opens a block that names its methods' receiver."""
    code = _blank(text)
    lines, raw, depth = code.split("\n"), text.split("\n"), _depths(code)
    out, owners = [], []
    for i, line in enumerate(lines):
        owners = [o for o in owners if o[1] < depth[i]]
        inside = owners[-1][0] if owners else ""
        for want, kind, pattern in rules:
            if want is not None and depth[i] != (want + (1 if inside and want else 0) if want == 0 or not inside else want):
                continue
            if kind == "method" and owner is not None and not inside:
                continue
            m = pattern.match(line)
            if m and m["name"] not in ("_", "if", "for", "while", "switch", "return", "else", "sizeof"):
                receiver = m.groupdict().get("receiver") or (inside if kind == "method" else "")
                out.append(Symbol(kind, m["name"], i + 1, _end(lines, depth, i), receiver, package, _doc(raw, i)))
                break
        if owner is not None and (m := owner.match(line)):
            owners.append((m["name"], depth[i]))
    return out


@language(".go")
def go_symbols(path: str, text: str) -> list[Symbol]:
    p = re.search(r"(?m)^package\s+(\w+)", _blank(text))
    rules = [
        (0, "method", re.compile(r"func\s+\(\s*(?:\w+\s+)?(?P<receiver>\*?\w+)[^)]*\)\s*(?P<name>\w+)\s*[\[(]")),
        (0, "function", re.compile(r"func\s+(?P<name>\w+)\s*[\[(]")),
        (0, "type", re.compile(r"type\s+(?P<name>\w+)\s+\S")),
        (0, "const", re.compile(r"const\s+(?P<name>\w+)\b")),
        (0, "var", re.compile(r"var\s+(?P<name>\w+)\b")),
    ]
    return _scan(text, p[1] if p else module_name(path), rules)


@language(".rs")
def rust_symbols(path: str, text: str) -> list[Symbol]:
    pub = r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:unsafe\s+)?(?:async\s+)?(?:const\s+)?(?:extern\s+\S+\s+)?"
    vis = r"\s*(?:pub(?:\([^)]*\))?\s+)?"
    rules = [
        (1, "method", re.compile(pub + r"fn\s+(?P<name>\w+)")),
        (0, "function", re.compile(pub + r"fn\s+(?P<name>\w+)")),
        (0, "type", re.compile(vis + r"(?:struct|enum|trait|union|type)\s+(?P<name>\w+)")),
        (0, "const", re.compile(vis + r"const\s+(?P<name>\w+)\s*:")),
        (0, "static", re.compile(vis + r"static\s+(?:mut\s+)?(?P<name>\w+)\s*:")),
    ]
    return _scan(text, module_name(path), rules, re.compile(r"\s*(?:unsafe\s+)?(?:impl(?:<[^{]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?|(?:pub(?:\([^)]*\))?\s+)?trait\s+)(?P<name>\w+)[^{;]*\{"))


_C_FUNCTION = r"(?!\s*(?:return|else|if|for|while|switch|typedef|using|namespace)\b)\s*(?:[\w:<>,*&~]+\s+)+[*&]*(?P<name>\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{"
_C_RULES = [
    (None, "macro", re.compile(r"\s*#\s*define\s+(?P<name>\w+)(?!\()(?:\s|$)")),
    (0, "type", re.compile(r"(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)\s*\{")),
    (0, "type", re.compile(r"typedef\s+[^;{]*?\b(?P<name>\w+)\s*;")),
    (0, "function", re.compile(_C_FUNCTION)),
    (0, "var", re.compile(r"(?!\s*(?:return|typedef|extern|using|namespace)\b)(?:static\s+|const\s+)*[A-Za-z_][\w\s*]*?[\s*](?P<name>\w+)\s*(?:\[[^\]]*\]\s*)*(?:=[^;]*)?;")),
]


@language(".c", ".h")
def c_symbols(path: str, text: str) -> list[Symbol]:
    return _scan(text, module_name(path), _C_RULES)


@language(".cpp", ".cc", ".cxx", ".hpp", ".hh")
def cpp_symbols(path: str, text: str) -> list[Symbol]:
    rules = [
        (1, "method", re.compile(_C_FUNCTION)),
        (0, "type", re.compile(r"\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|union|enum(?:\s+class)?)\s+(?P<name>\w+)[^;]*\{")),
        (0, "type", re.compile(r"\s*using\s+(?P<name>\w+)\s*=")),
        *_C_RULES,
    ]
    return _scan(text, module_name(path), rules, re.compile(r"\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<name>\w+)[^;{]*\{"))


def symbols_of(path: str, text: str) -> list[Symbol]:
    """Symbols of a file by its extension; none for an unknown one."""
    parser = next((f for e, f in _LANGUAGES.items() if path.endswith(e)), None)
    return parser(path, text) if parser else []


def read_symbols(spark: SparkSession, root: str) -> DataFrame:
    """All symbols under ``root``; a file that can't be parsed gives a row with its error. First of equal native ids stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["value"]):
                try:
                    rows += [(path, s.kind, s.name, s.receiver, s.package, s.doc, s.start_line, s.end_line, None) for s in symbols_of(path, text)]
                except (SyntaxError, tokenize.TokenError, ValueError) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"start_line": "Int32", "end_line": "Int32"})

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(sorted(_LANGUAGES)) + "}").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value").filter(~F.col("path").rlike("/(" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    return files.mapInPandas(run, SCHEMA)


def ordered(symbols: DataFrame) -> DataFrame:
    """Symbols by file, line and name."""
    return symbols.orderBy("file", "start_line", "name")


def native_ids(symbols: DataFrame) -> DataFrame:
    """Symbols with native_key, parent (the receiver's type in the same package, or null) and traces; the first of each key stays."""
    key = F.when(F.coalesce(F.col("receiver"), F.lit("")) != "", F.concat_ws(".", "receiver", "name")).otherwise(F.col("name"))
    first = F.min_by(F.struct("*"), F.struct("file", "start_line", "name"))
    s = symbols.filter("error IS NULL").withColumn("native_key", key).groupBy("package", "native_key").agg(first.alias("s")).select("s.*")
    types = s.filter("coalesce(receiver, '') = ''").select("package", F.col("native_key").alias("_r"), F.col("native_key").alias("parent"))
    s = s.withColumn("_r", F.regexp_replace("receiver", r"^\*?\[?|\]$", "")).join(types, ["package", "_r"], "left").drop("_r")
    return s.withColumns({"trace": R.marked_traces(F.col("doc")), "heuristic_trace": R.heuristic_traces(F.col("doc"))})
