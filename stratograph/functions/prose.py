"""Column functions over documentation text: splitting, extraction, scoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks that a splitter holds before it hands them on, those of one text apart.
CHUNKS = 2000
#: Words: runs of letters, marks, digits and connectors, in any script.
WORDS = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
#: Headers and links in Markdown.
SECTION = r"(?m)^#+\s"
LINK = r"\[.*?\]\(.*?\)"
#: Entities looked for in documentation.
CLASS_ENTITY = "`([A-Z][a-zA-Z0-9]*(?:Service|Repository|Controller|Factory|Handler|Manager|Provider|Client|Builder|Validator|Processor|Analyzer|Generator|Agent))`"
FUNCTION_ENTITY = r"`([A-Z][a-zA-Z0-9]*(?:Async)?)\(`"
PATTERN_ENTITY = r"(?i)\b(Repository|Factory|Singleton|Observer|Strategy|Command|CQRS|MVC|MVP|MVVM|Microservice|Event[- ]?Driven|Pub[- ]?Sub|Queue|Pipeline)\b"
DEPENDENCY_ENTITY = r"(?i)\b(PostgreSQL|MySQL|MongoDB|Redis|RabbitMQ|Kafka|Elasticsearch|Stripe|Twilio|AWS|Azure|GCP|Docker|Kubernetes)\b"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS))


def section_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SECTION))


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """array of chunks of ``size`` characters, each ``overlap`` into the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below size")
    step = size - overlap
    n = F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(n > 0, chunks).otherwise(F.array().cast("array<string>"))


def _fixed(text: str, size: int, overlap: int) -> list[str]:
    out, at = [], 0
    while at < len(text):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += size - overlap
    return out


def semantic_split(text: str, size: int, overlap: int) -> list[str]:
    """Split before Markdown headers, merging sections up to ``size`` and cutting longer ones.

    What stands before the first header is a section of its own."""
    import re

    at = [m.start() for m in re.finditer(r"^#+\s+", text, re.M)]
    if not at:
        return _fixed(text, size, overlap)
    bounds = ([0] if at[0] else []) + at + [len(text)]
    out, held = [], ""
    for a, b in zip(bounds, bounds[1:]):
        part = text[a:b]
        if len(part) > size:
            out += [held] if held else []
            held = ""
            out += _fixed(part, size, overlap)
        elif len(held) + len(part) > size:
            out.append(held)
            held = part
        else:
            held += part
    return out + ([held] if held else [])


def line_chunks(text: str, most: int = 512) -> list[tuple[str, int, int]]:
    """Lines packed to ``most`` tokens of four characters: (chunk, first line, last line)."""
    if not text.strip():
        return []
    lines = text.split("\n")
    if len(text) // 4 <= most:
        return [(text, 1, len(lines))]
    out, held, first = [], "", 1
    for i, line in enumerate(lines, 1):
        line += "\n"
        if held and len(held + line) // 4 > most:
            out.append((held, first, i - 1))
            held, first = "", i
        held += line
    return out + [(held, first, len(lines))]


def paragraph_chunks(text: str, most: int = 512, overlap: int = 50) -> list[str]:
    """Paragraphs packed to ``most`` tokens; a longer one is cut with ``overlap`` tokens kept."""
    out, held = [], ""
    for p in (p for p in text.split("\n\n") if p.strip()):
        if len(p) // 4 > most:
            out += ([held] if held else []) + _fixed(p, most * 4, overlap * 4)
            held = ""
        elif held and (len(held) + 2 + len(p)) // 4 > most:
            out.append(held)
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return out + ([held] if held else [])


def chunked(rows: DataFrame, how: str, text: str, **options) -> DataFrame:
    """rows with (chunk_no, chunk, first_line, last_line); how: semantic, lines or paragraphs.

    The splitters are folds over one text; they run on Arrow batches, row by row inside,
    and hand chunks on by about CHUNKS, however many a batch gives."""
    split = {"semantic": semantic_split, "lines": line_chunks, "paragraphs": paragraph_chunks}[how]
    keys = [c for c in rows.columns if c != text]

    def frame(out: list[list]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*keys, "chunk_no", "chunk", "first_line", "last_line"]).astype({"first_line": "Int64", "last_line": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                row = row._asdict()
                for i, c in enumerate(split(row[text] or "", **options)):
                    c = c if isinstance(c, tuple) else (c, None, None)
                    out.append([row[k] for k in keys] + [i, *c])
                if len(out) >= CHUNKS:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInPandas(run, f"{schema}, chunk_no int, chunk string, first_line long, last_line long")


def entities(text: Column) -> Column:
    """Struct of classes, functions, patterns and dependencies: distinct, in order, capped."""
    def found(pattern: str, most: int, longer: int = 0, fold: bool = False) -> Column:
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        names = F.transform(names, lambda x: F.lower(x)) if fold else F.filter(names, lambda x: F.length(x) > longer)
        return F.slice(F.array_distinct(names), 1, most)

    return F.struct(
        found(CLASS_ENTITY, 20, 3).alias("classes"), found(FUNCTION_ENTITY, 20, 3).alias("functions"),
        found(PATTERN_ENTITY, 10, fold=True).alias("patterns"), found(DEPENDENCY_ENTITY, 10, fold=True).alias("dependencies"),
    )


def first_paragraph(text: Column, most: int = 200) -> Column:
    """The first run of lines that are neither blank nor headers, joined by spaces and cut."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#"))
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("held"))

    def step(s: Column, x: Column) -> Column:
        blank = x == ""
        keep = ~s["over"] & ~blank
        return F.struct((s["on"] | ~blank).alias("on"), (s["over"] | (s["on"] & blank)).alias("over"), F.when(keep, F.concat(s["held"], F.array(x))).otherwise(s["held"]).alias("held"))

    joined = F.array_join(F.aggregate(lines, start, step)["held"], " ")
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most - 3), F.lit("..."))).otherwise(joined)


def key_topics(text: Column, most: int = 5) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("## ") | F.ltrim(x).startswith("### "))
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, "^[# ]+", "")), 1, most)


def concrete_details(text: Column, most: int = 8) -> Column:
    spans = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    spans = F.filter(spans, lambda x: (F.length(x) > 2) & (F.length(x) < 50) & ~x.contains("\n"))
    return F.slice(F.array_distinct(spans), 1, most)


def citations(text: Column, sources: Column) -> Column:
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"\[{1,2}\s*(\d+)\s*\]{1,2}"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.filter(marks, lambda x: x.isNotNull() & (x >= 1) & (x <= sources))


def readability(text: Column) -> Column:
    """100 less 20 or 10 for length, 15 for sections, 10 for missing code, 5 for links; 0 at least.

    A page with "function" always loses the points for code."""
    words = word_count(text)
    blocks = F.floor(F.regexp_count(text, F.lit("```")) / 2)
    score = F.lit(100.0) - F.when(words < 50, 20).when(words > 2000, 10).otherwise(0) - F.when(section_count(text) < 2, 15).otherwise(0)
    score = score - F.when(((blocks == 0) & text.contains("class")) | text.contains("function"), 10).otherwise(0)
    return F.greatest(F.lit(0.0), score - F.when(F.regexp_count(text, F.lit(LINK)) == 0, 5).otherwise(0))


#: Percentages, named and given scores, and bare numbers in a judge's answer.
PERCENT = r"(?i)(\d+(?:\.\d+)?)\s*(?:%|percent)"
NAMED = r"(?i)(?:score|rating)\s*(?:is|=|:)?\s*(-?\d+(?:\.\d+)?)"
GIVEN = r"(?i)(?:scores?|gives?|rate[sd]?)\s+(?:it\s+)?(?:a\s+)?(?:score\s+)?(?:of\s+)?(-?\d+(?:\.\d+)?)"
BARE = r"\b(-?\d+(?:\.\d+)?)\b"


def score(text: Column) -> Column:
    """A judge's score in [0, 1]: a percentage, a named score, a bare number, Yes or No, else 0.5."""
    t = F.trim(text)

    def number(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("double")

    percent = F.coalesce(number(PERCENT), F.lit(None).cast("double")) / 100.0
    named = number(NAMED)
    given = number(GIVEN)
    bare = F.transform(F.regexp_extract_all(t, F.lit(BARE), F.lit(1)), lambda x: x.try_cast("double"))
    bare = F.get(F.filter(bare, lambda x: F.abs(x) <= 1.5), F.lit(0))
    low = F.lower(t)
    yes = F.when(low.startswith("yes") | low.contains("\nyes"), 1.0).when(low.startswith("no") | low.contains("\nno"), 0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(percent, named, given, bare, yes, F.lit(0.5))))


def salvage_json(text: Column) -> Column:
    """From the first opening to the last closing brace, fences dropped."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def mermaid(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?s)```(?:mermaid)?\s*\n(.*?)```", 1)
    return F.when(block != "", F.trim(block)).otherwise(F.trim(text))


def clean_page(text: Column, title: Column) -> Column:
    """Generated Markdown without its outer fence, source lists and repeated title."""
    t = F.trim(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"^```markdown[\r\n]*", ""), r"\s*```$", "")
    t = F.trim(F.regexp_replace(t, r"(?is)<details>\s*<summary>\s*Relevant source files\s*</summary>.*?</details>", ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"^\s*#\s*", ""))) != F.lower(title))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.trim(F.array_join(lines, "\n")))


def requirement_key(text: Column) -> Column:
    return F.trim(F.translate(F.lower(text), ".,;", ""))


def requirement_category(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.rlike("example|code|sample"), "Code Examples").when(t.rlike("api|endpoint|method"), "API Coverage")
        .when(t.rlike("structure|organization|format"), "Structure & Organization").otherwise("Documentation Quality")
    )


def section_priority(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.contains("overview"), 1).when(t.contains("application"), 2).when(t.contains("domain"), 3).when(t.contains("repository"), 10).when(t.contains("others"), 11).otherwise(5)


def agreement(lengths_mean: Column, lengths_std: Column, n: Column) -> Column:
    return F.when(n < 2, 1.0).when(lengths_mean == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lengths_std / lengths_mean)))


def uncertainty(agreed: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - agreed) * F.greatest(F.lit(0.5), 1 - (n - 1) * 0.1)))
