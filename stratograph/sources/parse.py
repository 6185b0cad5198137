"""Source files to nodes and arcs: a light parser for brace languages and Python.

It blanks comments and strings, finds declarations and the span of their bodies, and counts
decision points inside.  Files are parsed where they lie, a batch of rows at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import GRAPH_LANGUAGES, IMPORTED, ignored_in_graph, language
from .model import Graph, build

_BLANK = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|/\*[\s\S]*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')
_HASH = re.compile(r"#[^\n]*")
_TYPE = re.compile(r"\b(class|interface|struct|enum|record)\s+(\w+)(?:<[^>{]*>)?\s*(?:\([^)]*\))?\s*(?::|extends|implements)?\s*([^{;]{0,500})\{")  # a list of bases is short: prose is not searched to its end
_METHOD = re.compile(r"\b(?!(?:if|for|foreach|while|switch|catch|using|lock|return|new|else)\b)(\w+)\s*(?:<[^>()]*>)?\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:where[^{]{0,500}|=>|throws[^{]{0,500})?\s*\{")
_PROPERTY = re.compile(r"\b\w+\s*\{\s*(?:public|private|protected|internal)?\s*(?:get|set|init)\b")
_PY_TYPE = re.compile(r"^([ \t]*)class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:", re.M)
_PY_DEF = re.compile(r"^([ \t]*)(?:async\s+)?def\s+(\w+)\s*\(", re.M)
_WALK = re.compile(r"\b(?:if|for|foreach|while|case|catch)\b")
_PY_WALK = re.compile(r"\b(?:if|elif|for|while|except|and|or)\b")
#: Times a file's parser is tried.
ATTEMPTS = 3
#: Files whose texts and findings a task holds at a time.
FILES = 256
#: The language's name in the tables of import patterns.
_NAMES = {"C#": "csharp", "JavaScript": "javascript", "TypeScript": "javascript", "Java": "java", "Python": "python", "C": "c", "C++": "c"}


def blanked(text: str, lang: str) -> str:
    """The text with comments and strings as spaces, line feeds kept."""
    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m.group())

    text = _BLANK.sub(blank, text) if lang != "Python" else re.sub(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', blank, text)
    return _HASH.sub(blank, text) if lang == "Python" else text


def body_end(code: str, start: int) -> int:
    """The place after the brace that closes the one at ``start``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def attributes_before(code: str, at: int) -> str:
    """The lines above a declaration that begin with an attribute or an annotation."""
    start = code.rfind("\n", 0, at) + 1
    first = start
    while first:
        above = code.rfind("\n", 0, first - 1) + 1
        if code[above:first].lstrip()[:1] not in ("[", "@"):
            break
        first = above
    return code[first:start]


def walker_complexity(code: str) -> int:
    return 1 + len(_WALK.findall(code))


def type_complexity(code: str) -> int:
    """Decision points, operators, methods and properties of a type's body; switches count twice."""
    count = lambda p: len(re.findall(p, code))
    points = count(r"\bif\b") + 2 * count(r"\bswitch\b") + count(r"\bwhile\b") + count(r"\bfor\b") + count(r"\bforeach\b")
    operators = count(r"&&") + count(r"\|\|") + count(r"[^?]\?[^?.\[:]")
    return 1 + points + operators + len(_METHOD.findall(code)) + len(_PROPERTY.findall(code))


def script_complexity(code: str) -> int:
    """One and the decision nodes of a script; logical operators count once more as binary ones."""
    count = lambda p: len(re.findall(p, code))
    nodes = sum(count(rf"\b{w}\b") for w in ("if", "for", "while", "do", "case", "catch", "switch"))
    logical = count(r"&&") + count(r"\|\|")
    return 1 + nodes + count(r"[^?]\?[^?.:]") + 2 * logical + count(r"[^&]&[^&]")


def component_type(kind: str, name: str, attributes: str) -> str:
    for word in ("Controller", "Service", "Repository"):
        if word in attributes:
            return word
    for word in ("Service", "Repository", "Controller"):
        if name.endswith(word):
            return word
    return kind.capitalize()


#: Parsers by language, (path, language, text) -> (nodes, arcs), that stand in for the light one.
PARSERS: dict[str, Callable[[str, str, str], tuple[list[tuple], list[tuple]]]] = {}


def parse_file(path: str, lang: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, arcs): nodes (id, type, name, lines, complexity), arcs (src, name of target, type).

    The file itself is a node that contains its types; imports are arcs of the file."""
    code = blanked(text, lang)
    file_complexity = 1 + len(_PY_WALK.findall(code)) if lang == "Python" else script_complexity(code) if lang.endswith("Script") else walker_complexity(code)
    nodes = [(path, "File", re.split(r"[/\\]", path)[-1], text.count("\n") + 1, file_complexity)]
    arcs = [(path, m, "Dependency") for m in re.findall(IMPORTED[_NAMES[lang]], text)] if lang in _NAMES else []
    found = []
    if lang == "Python":
        for m in _PY_TYPE.finditer(code):
            rest = re.compile(rf"^[ \t]{{0,{len(m.group(1))}}}\S", re.M).search(code, m.end())
            found.append(("class", m.group(2), m.group(3) or "", "", code[m.end() : rest.start() if rest else len(code)]))
        for m in _PY_DEF.finditer(code):
            if not m.group(1):
                found.append(("function", m.group(2), "", "", ""))
    else:
        for m in _TYPE.finditer(code):
            found.append((m.group(1), m.group(2), m.group(3), attributes_before(code, m.start()), code[m.end() - 1 : body_end(code, m.end() - 1)]))
    for kind, name, bases, attributes, body in found:
        node = f"{path}::{name}"
        complexity = 1 + len(_PY_WALK.findall(body)) if lang == "Python" else type_complexity(body)
        nodes.append((node, component_type(kind, name, attributes), name, body.count("\n") + 1, complexity))
        arcs.append((path, node, "Contains"))
        for base in (b.split("<")[0].strip() for b in re.split(r",|\bimplements\b|\bextends\b", bases)):
            if re.fullmatch(r"[\w.]+", base):
                implements = re.match(r"I[A-Z]", base) or kind == "interface"
                arcs.append((node, base.split(".")[-1], "Implementation" if implements else "Inheritance"))
    return nodes, arcs


def _tried(parser, path: str, lang: str, text: str) -> tuple[list[tuple], list[tuple]]:
    for _ in range(ATTEMPTS):
        try:
            return parser(path, lang, text)
        except (ValueError, OSError, RecursionError):
            continue
    return [], []


def parsed(files: DataFrame, parsers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, arcs by name) of files (path, content), ignored paths and unknown languages left out.

    parsers: by language, in place of the light parser; a parser that fails is tried
    ATTEMPTS times, then the file alone is left out, so one bad file stops no job."""
    own = {**PARSERS, **(parsers or {})}
    rows = files.filter(~ignored_in_graph(F.col("path"))).withColumn("language", language(F.col("path"), GRAPH_LANGUAGES)).filter("language <> 'Unknown'")
    rows = rows.select("path", "language", F.coalesce("content", F.lit("")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int32()] * 2
        names = ["kind", "path", "language", "id", "type", "name", "lines", "complexity"]
        for batch in batches:
            for first in range(0, batch.num_rows, FILES):  # texts and findings of so many files are held, not those of a batch
                out = []
                for path, lang, text in zip(*(c.to_pylist() for c in batch.slice(first, FILES).columns)):
                    nodes, arcs = _tried(own.get(lang, parse_file), path, lang, text)
                    out += [("node", path, lang, *n) for n in nodes]
                    out += [("arc", path, lang, a[0], a[2], a[1], 0, 0) for a in arcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    both = rows.mapInArrow(run, "kind string, path string, language string, id string, type string, name string, lines int, complexity int")
    nodes = both.filter("kind = 'node'").select(F.col("id").alias("node_id"), "type", "name", "language", F.col("path").alias("file_path"), F.col("lines").alias("line_count"), "complexity")
    return nodes, both.filter("kind = 'arc'").select(F.col("id").alias("src"), F.col("name").alias("target"), "type")


def graph_of(files: DataFrame) -> Graph:
    """The graph of a source tree: targets resolve to an id, else to the first node of that name
    or the first file of that stem."""
    nodes, arcs = parsed(files)
    stem = F.regexp_replace(F.element_at(F.split("name", r"[/\\]"), -1), r"\.[^.]+$", "")
    keys = nodes.select("node_id", F.explode(F.array_distinct(F.array("node_id", "name", stem))).alias("target"))
    first = keys.groupBy("target").agg(F.min("node_id").alias("dst"))
    last = F.element_at(F.split("target", r"[./\\]"), -1)
    whole = arcs.join(first, "target", "left")
    short = first.select(F.col("target").alias("short"), F.col("dst").alias("dst2"))
    rows = whole.withColumn("short", last).join(short, "short", "left").withColumn("to", F.coalesce("dst", "dst2")).filter("to is not null and to <> src")
    rows = rows.select(F.xxhash64("src", "to", "type").alias("seq"), "src", F.col("to").alias("dst"), "type", F.lit(1.0).alias("strength"))
    return build(nodes, rows)
