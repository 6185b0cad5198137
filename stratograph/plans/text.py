"""Queries over source text, paths and documentation text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code, prose
from ..operators import references
from ..registry import Registry
from ..sources import model
from ..sources.tables import table
from .bindings import OCCURRENCES, names, on_graph

R = Registry()


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_q(pattern)}))"


def _sum(column: str, patterns) -> str:
    return " + ".join(_count(column, p) for p in patterns)


def _html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("t"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))


def _paths(spark, sf_dir):
    return model.nodes(spark, sf_dir).select("node_id", "file_path")


#: What the base tables' texts do not hold: one is put behind each whole text, dealt by id.
SNIPPETS = (
    "using System;\npublic class A : B {\n  if (x) { foo(); } else if (y) { }\n  for (;;) { }\n}\n/// doc",
    "import os\nfrom a.b import c\ndef main():\n    x = a ? b : c && d || e\nclass K(Base):\n    self.run()\n",
    "function main() { app.listen(3); }\nclass W extends V {}\nexport const q = (a) => { }\n// note",
    "@RestController\npublic interface Shop { }\nswitch (a) { case 1: break; }\ncatch (e) { }",
    "# Title\n\nIntro one.\nIntro two.\n\n## Overview\n`UserService` uses Redis and `Run(`\n```\ncode\n```\n[a](b) [1] [[2]]\n## More\n- x",
    "Score: 0.85 because it is good",
    "I would give it 75% overall",
    "Yes, it does",
    "prefix {\"a\": {\"b\": 1}} suffix",
    "no structure at all; the API has a sample, e.g. `abc` and `a_long_name`.",
)


def _texts(spark, sf_dir):
    """(doc_id, t): every whole text and a snippet behind it."""
    snippet = F.get(F.array(*[F.lit(x) for x in SNIPPETS]), F.pmod("doc_id", F.lit(len(SNIPPETS))).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), snippet).alias("t"))


_TEXTS = "tx AS (SELECT doc_id, coalesce(text, '') || chr(10) || ([{}])[1 + (doc_id % {})::INT] AS t FROM documents)".format(", ".join(_q(x) for x in SNIPPETS), len(SNIPPETS))


def _on(select: str, *more: str) -> str:
    return "WITH " + ", ".join([_TEXTS, *more]) + " " + select


def _both(name: str, select: str, *columns):
    """A query over the texts: ``columns`` are made by a function of the text column."""

    def register(build):
        @R.query(name, _on(select))
        def run(spark, sf_dir):
            return _texts(spark, sf_dir).select("doc_id", *build(F.col("t")))

        run.__doc__ = build.__doc__
        return run

    return register


@_both("x01_cyclomatic", f"SELECT doc_id, 1 + {_sum('t', code.DECISIONS)} AS complexity FROM tx")
def x01(t):
    """One and the decision points in the text."""
    return [code.cyclomatic(t).alias("complexity")]


@_both("x05_nesting_depth", f"""SELECT doc_id, (SELECT greatest(0, max(s))::INT FROM (SELECT sum(d) OVER (ORDER BY i) AS s FROM
  (SELECT i, {_count('x', r'{')} + {_count('x', code.NESTING)} - {_count('x', r'}')} AS d FROM (SELECT unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i)))) AS depth FROM tx""")
def x05(t):
    """The greatest running depth by line."""
    return [code.nesting_depth(t).alias("depth")]


@R.query("x06_x07_x08_x10_estimates", on_graph("""SELECT node_id, CASE WHEN complexity <= 5 THEN 1 WHEN complexity <= 10 THEN 2 WHEN complexity <= 20 THEN 3 ELSE 4 END AS nesting,
  line_count * 1.3::DOUBLE + complexity * 10 AS component_tokens, line_count * 1.3::DOUBLE AS file_tokens, line_count * 4 AS tokens, line_count * 4 / 8192.0::DOUBLE * 100 AS share, line_count * 4 > 0.8 * 8192 AS chunked FROM nodes"""))
def x06(spark, sf_dir):
    """Nesting and token estimates from lines and complexity."""
    lines, c = F.col("line_count"), F.col("complexity")
    tokens, share, chunked = code.context_share(lines)
    return model.nodes(spark, sf_dir).select(
        "node_id", code.nesting_estimate(c).alias("nesting"), code.component_tokens(lines, c).cast("double").alias("component_tokens"),
        code.file_tokens(lines).cast("double").alias("file_tokens"), tokens.alias("tokens"), share.alias("share"), chunked.alias("chunked"),
    )


@R.query("x09_text_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def x09(spark, sf_dir):
    """A quarter of the characters, rounded down."""
    return _docs(spark, sf_dir).select("doc_id", code.text_tokens(F.col("t")).alias("tokens"))


@_both("x12_public_content", f"SELECT doc_id, regexp_matches(t, {_q('(?i)' + '|'.join(code.PUBLIC))}) AS is_public FROM tx")
def x12(t):
    """Content that exports something."""
    return [code.is_public(t).alias("is_public")]


@_both("x13_documented", f"SELECT doc_id, regexp_matches(t, {_q('|'.join(code.DOCUMENTED))}) AS documented FROM tx")
def x13(t):
    """Content with comments or quotes."""
    return [code.is_documented(t).alias("documented")]


@_both("x14_fan_out", f"SELECT doc_id, {_sum('t', code.IMPORTS)} AS imports FROM tx")
def x14(t):
    """Imports counted over five forms."""
    return [code.imports(t).alias("imports")]


@_both("x15_content_type", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN '{n}'" for p, n in code.CONTENT_TYPES) + " ELSE 'Component' END AS type FROM tx")
def x15(t):
    """Component type by the first declaration found."""
    return [code.content_type(t).alias("type")]


@R.query("x16_symbol_type", """SELECT c_custkey, CASE WHEN contains(c_mktsegment, 'MACHINERY') THEN 'Controller' WHEN c_name LIKE '%7' THEN 'Service' ELSE 'Class' END AS symbol,
  CASE WHEN contains(lower(c_name), '#000000007') THEN 'Service' WHEN c_mktsegment <> '' THEN c_mktsegment ELSE 'Class' END AS parsed FROM customer""")
def x16(spark, sf_dir):
    """Type of a symbol by attribute, base and name; and of a parsed class."""
    rows = table(spark, sf_dir, "customer")
    attributes = F.array(F.replace("c_mktsegment", F.lit("MACHINERY"), F.lit("ApiController")))
    name = F.when(F.col("c_name").endswith("7"), "UserService").otherwise(F.col("c_name"))
    parsed = F.when(F.col("c_name").contains("#000000007"), "shopservice").otherwise(F.col("c_name"))
    return rows.select("c_custkey", code.symbol_type(attributes, F.lit("Object"), name, F.lit("Class")).alias("symbol"), code.parsed_type(parsed, F.col("c_mktsegment")).alias("parsed"))


def _all(patterns, flag="(?i)"):
    return "flatten([" + ", ".join(f"regexp_extract_all(t, {_q(flag + p)}, 1)" for p in patterns) + "])"


@_both("x17_generic_declarations", f"SELECT doc_id, array_to_string({_all(code.GENERIC_CLASSES)}, ',') AS classes, array_to_string({_all(code.GENERIC_FUNCTIONS)}, ',') AS functions FROM tx")
def x17(t):
    """Classes and functions by regex, whatever the language."""
    return [F.array_join(code.declarations(t, code.GENERIC_CLASSES), ",").alias("classes"), F.array_join(code.declarations(t, code.GENERIC_FUNCTIONS), ",").alias("functions")]


@_both("x18_java_declarations", f"SELECT doc_id, array_to_string({_all([code.JAVA_CLASS, code.JAVA_INTERFACE], '')}, ',') AS names FROM tx")
def x18(t):
    """Java classes and interfaces, each once."""
    return [F.array_join(code.declarations(t, (code.JAVA_CLASS, code.JAVA_INTERFACE), False), ",").alias("names")]


@_both("x19_python_declarations", f"SELECT doc_id, array_to_string({_all([code.PYTHON_CLASS, code.PYTHON_FUNCTION], '')}, ',') AS names FROM tx")
def x19(t):
    """Python classes without bases and functions."""
    return [F.array_join(code.declarations(t, (code.PYTHON_CLASS, code.PYTHON_FUNCTION), False), ",").alias("names")]


@R.query("x20_entry_by_language", _on("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_matches(t, 'app\\.listen\\s*\\(|ReactDOM\\.render|bootstrap\\(\\)') WHEN 1 THEN regexp_matches(t, 'int\\s+main\\s*\\(') ELSE false END AS entry FROM tx"))
def x20(spark, sf_dir):
    """Entry points by language."""
    lang = F.get(F.array(F.lit("JavaScript"), F.lit("c"), F.lit("Cobol")), (F.col("doc_id") % 3).cast("int"))
    return _texts(spark, sf_dir).select("doc_id", code.is_entry_point(F.col("t"), lang).alias("entry"))


@R.query("x24_diagram_layer", "SELECT p_partkey, CASE lower(p_type) WHEN 'service' THEN 'Business' ELSE 'Unknown' END AS layer FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Service' ELSE p_type END AS p_type FROM part)")
def x24(spark, sf_dir):
    """Layer of a component type in diagrams."""
    from ..operators.architecture import diagram_layer

    kind = F.when(F.col("p_partkey") % 3 == 0, "Service").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", diagram_layer(kind).alias("layer"))


@R.query("x25_parent_directory", on_graph("SELECT node_id, string_split(file_path, '/')[-2] AS directory FROM nodes"))
def x25(spark, sf_dir):
    """The directory a file lies in."""
    return _paths(spark, sf_dir).select("node_id", code.parent_directory(F.col("file_path")).alias("directory"))


@R.query("x26_common_path", on_graph("""SELECT type, coalesce((SELECT max(array_to_string(lo[1:k], '/')) FROM (SELECT unnest(range(0, len(lo) + 1)) AS k) WHERE lo[1:k] = hi[1:k] AND k = (SELECT max(j) FROM (SELECT unnest(range(0, len(lo) + 1)) AS j) WHERE lo[1:j] = hi[1:j])), '') AS path
  FROM (SELECT type, min(d) AS lo, max(d) AS hi FROM (SELECT type, string_split(file_path, '/')[1:-2] AS d FROM nodes) GROUP BY type)"""))
def x26(spark, sf_dir):
    """The directories that all files of a type share."""
    parts = F.slice(code.segments(F.col("file_path")), F.lit(1), F.size(code.segments(F.col("file_path"))) - 1)
    rows = model.nodes(spark, sf_dir).groupBy("type").agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    return rows.select("type", code.common_path(F.col("lo"), F.col("hi")).alias("path"))


@R.query("x27_sanitised_names", on_graph("SELECT node_id, trim(translate(file_path, '/\\_', '   ')) AS name FROM nodes"))
def x27(spark, sf_dir):
    """Separators and underscores as spaces."""
    from ..operators.architecture import sanitised

    return _paths(spark, sf_dir).select("node_id", sanitised(F.col("file_path")).alias("name"))


@R.query("x28_fixed_split", """SELECT doc_id, i AS chunk_no, substring(text, i * 450 + 1, 500) AS chunk FROM
  (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 500 THEN 1 ELSE ceil((length(text) - 500) / 450.0)::INT + 1 END)) AS i FROM documents WHERE length(text) > 0)""")
def x28(spark, sf_dir):
    """Chunks of 500 characters, 50 shared."""
    rows = _docs(spark, sf_dir)
    return rows.select("doc_id", F.posexplode(prose.fixed_chunks(F.col("t"), 500, 50)).alias("chunk_no", "chunk")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


def _cut(x: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"list_transform(range(0, CASE WHEN length({x}) <= {size} THEN 1 ELSE ceil((length({x}) - {size}) / {step}.0)::INT + 1 END), lambda k: substring({x}, k * {step} + 1, {size}))"


_CHUNKS = "SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS chunk_no, unnest(c) AS chunk FROM"


@R.query("x29_semantic_split", "WITH RECURSIVE " + _TEXTS + f""", p AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '(?m)^(#+\\s+)', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '') AS ps, regexp_matches(t, '(?m)^#+\\s+') AS headed FROM tx),
  f AS (SELECT doc_id, 0 AS i, '' AS held, []::VARCHAR[] AS o, ps FROM p WHERE headed UNION ALL SELECT doc_id, i + 1, CASE WHEN length(x) > 60 THEN '' WHEN length(held) + length(x) > 60 THEN x ELSE held || x END,
    CASE WHEN length(x) > 60 THEN o || CASE WHEN held <> '' THEN [held] ELSE [] END || {_cut('x', 60, 10)} WHEN length(held) + length(x) > 60 THEN o || [held] ELSE o END, ps FROM (SELECT *, ps[i + 1] AS x FROM f WHERE i < len(ps)))
  {_CHUNKS} (SELECT doc_id, CASE WHEN held <> '' THEN o || [held] ELSE o END AS c FROM f WHERE i = len(ps) UNION ALL SELECT doc_id, {_cut('t', 60, 10)} FROM p WHERE NOT headed AND t <> '')""")
def x29(spark, sf_dir):
    """Sections by Markdown header, merged and cut to 60 characters."""
    return prose.chunked(_texts(spark, sf_dir), "semantic", "t", size=60, overlap=10).select("doc_id", "chunk_no", "chunk")


@R.query("x30_line_chunks", """WITH RECURSIVE p AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '\\S')),
  f AS (SELECT doc_id, 0 AS i, '' AS held, 1 AS first, []::STRUCT(c VARCHAR, a INT, b INT)[] AS o, ls FROM p WHERE length(text) // 4 > 128 UNION ALL
    SELECT doc_id, i + 1, CASE WHEN full_ THEN x ELSE held || x END, CASE WHEN full_ THEN i + 1 ELSE first END, CASE WHEN full_ THEN o || [struct_pack(c := held, a := first, b := i)] ELSE o END, ls
    FROM (SELECT *, held <> '' AND (length(held) + length(x)) // 4 > 128 AS full_ FROM (SELECT *, ls[i + 1] || chr(10) AS x FROM f WHERE i < len(ls)))),
  r AS (SELECT doc_id, o || [struct_pack(c := held, a := first, b := len(ls)::INT)] AS c FROM f WHERE i = len(ls) UNION ALL SELECT doc_id, [struct_pack(c := text, a := 1, b := len(ls)::INT)] FROM p WHERE length(text) // 4 <= 128)
  SELECT doc_id, chunk_no, x.c AS chunk, x.a::BIGINT AS first_line, x.b::BIGINT AS last_line FROM (SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS chunk_no, unnest(c) AS x FROM r)""")
def x30(spark, sf_dir):
    """Lines packed to 128 tokens, with true line numbers."""
    return prose.chunked(_docs(spark, sf_dir), "lines", "t", most=128)


@R.query("x31_paragraph_chunks", f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')) AS ps FROM documents WHERE text IS NOT NULL),
  f AS (SELECT doc_id, 0 AS i, '' AS held, []::VARCHAR[] AS o, ps FROM p UNION ALL SELECT doc_id, i + 1, CASE WHEN long THEN '' WHEN held <> '' AND NOT full_ THEN held || chr(10) || chr(10) || x ELSE x END,
    CASE WHEN long THEN o || CASE WHEN held <> '' THEN [held] ELSE [] END || {_cut('x', 2048, 200)} WHEN full_ THEN o || [held] ELSE o END, ps
    FROM (SELECT *, held <> '' AND (length(held) + 2 + length(x)) // 4 > 512 AS full_ FROM (SELECT *, ps[i + 1] AS x, length(ps[i + 1]) // 4 > 512 AS long FROM f WHERE i < len(ps))))
  {_CHUNKS} (SELECT doc_id, CASE WHEN held <> '' THEN o || [held] ELSE o END AS c FROM f WHERE i = len(ps))""")
def x31(spark, sf_dir):
    """Paragraphs packed to 512 tokens."""
    return prose.chunked(_docs(spark, sf_dir), "paragraphs", "t").select("doc_id", "chunk_no", "chunk")


@R.query("x32_word_count", f"SELECT doc_id, {_count('text', prose.WORDS)} AS words FROM documents")
def x32(spark, sf_dir):
    """Words in any script."""
    return _docs(spark, sf_dir).select("doc_id", prose.word_count(F.col("t")).alias("words"))


@_both("x33_section_count", f"SELECT doc_id, {_count('t', prose.SECTION)} AS sections FROM tx")
def x33(t):
    """Markdown headers."""
    return [prose.section_count(t).alias("sections")]


@_both("x34_entities", f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, {_q(prose.CLASS_ENTITY)}, 1), lambda x: length(x) > 3), ',') AS classes,
  array_to_string(list_filter(regexp_extract_all(t, {_q(prose.FUNCTION_ENTITY)}, 1), lambda x: length(x) > 3), ',') AS functions,
  array_to_string(list_transform(regexp_extract_all(t, {_q(prose.DEPENDENCY_ENTITY)}, 1), lambda x: lower(x)), ',') AS dependencies FROM tx""")
def x34(t):
    """Names of classes, functions and dependencies in documentation."""
    e = prose.entities(t)
    return [F.array_join(e[k], ",").alias(k) for k in ("classes", "functions", "dependencies")]


@R.query("x35_first_paragraph", _on("""SELECT doc_id, CASE WHEN length(p) > 200 THEN p[1:197] || '...' ELSE p END AS summary FROM (SELECT doc_id, array_to_string(CASE WHEN stop > 0 THEN m[1:stop - 1] ELSE m END, ' ') AS p
  FROM (SELECT doc_id, m, list_position(m, '') AS stop FROM (SELECT doc_id, CASE WHEN start > 0 THEN l[start:] ELSE [] END AS m FROM (SELECT doc_id, l, list_position(list_transform(l, lambda x: x <> ''), true) AS start
  FROM (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: NOT starts_with(x, '#')) AS l FROM tx)))))"""))
def x35(spark, sf_dir):
    """The first paragraph after headers, cut to 200 characters."""
    return _texts(spark, sf_dir).select("doc_id", prose.first_paragraph(F.col("t")).alias("summary"))


@R.query("x36_cross_references", f"WITH {OCCURRENCES} SELECT doc_id, name, count(*) AS n FROM occurrences GROUP BY ALL")
def x36(spark, sf_dir):
    """How often each name of a dictionary, of one word or several, occurs in each text."""
    found = references.counted(_docs(spark, sf_dir).withColumnRenamed("doc_id", "id"), names(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "name", "n")


@R.query("x36_reference_places", rf"""WITH {OCCURRENCES} SELECT doc_id AS id, name, start AS "offset", length(name) AS length,
  regexp_replace(replace(text[greatest(0, start - 20) + 1:start + 50], chr(10), ' '), '^\s+|\s+$', '', 'g') AS context FROM occurrences JOIN documents USING (doc_id)""")
def x36_places(spark, sf_dir):
    """Offset, length and context of each reference."""
    return references.places(_docs(spark, sf_dir).withColumnRenamed("doc_id", "id"), names(spark, sf_dir))


def _linked(name: str, target: str) -> str:
    """Boundaries of the parts around a name tell whether it stands in brackets."""
    parts = f"string_split_regex(t, '\\b{name}\\b')"
    return f"""SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i = len(p) THEN '' WHEN p[i] LIKE '%[' OR p[i + 1] LIKE ']%' THEN '{name}' ELSE '[{name}]({target})' END), '') AS t FROM (SELECT doc_id, {parts} AS p FROM """


@R.query("x37_enriched_links", _on(_linked("User", "u.md") + "(" + _linked("Redis", "redis.md") + "(" + _linked("UserService", "user.md") + "tx)))))"))
def x37(spark, sf_dir):
    """Names as links, the longest first, bracketed ones left alone."""
    return _texts(spark, sf_dir).select("doc_id", references.linked(F.col("t"), {"UserService": "user.md", "User": "u.md", "Redis": "redis.md"}).alias("t"))


def _decided(rounds: int) -> str:
    """Which occurrences become links: a round keeps those whose betters are all dropped and drops those in a kept one's way."""
    out = ["s0 AS MATERIALIZED (SELECT doc_id, n, NULL::BOOLEAN AS kept FROM free)"]
    for i in range(rounds):
        kept = "CASE WHEN any_value(s.kept) IS NOT NULL THEN any_value(s.kept) WHEN bool_or(coalesce(h.kept, false)) THEN false WHEN bool_and(h.n IS NULL OR coalesce(NOT h.kept, false)) THEN true END"
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT s.doc_id, s.n, {kept} AS kept FROM s{i} s LEFT JOIN clash c ON c.doc_id = s.doc_id AND c.b = s.n LEFT JOIN s{i} h ON h.doc_id = c.doc_id AND h.n = c.a GROUP BY s.doc_id, s.n)")
    return ", ".join(out)


@R.query("x37_links_from_a_table", rf"""WITH {OCCURRENCES},
  free AS MATERIALIZED (SELECT doc_id, name, start, start + length(name) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name, start) AS n FROM occurrences JOIN documents USING (doc_id)
    WHERE text[start:start] <> '[' AND text[start + length(name) + 1:start + length(name) + 1] <> ']'),
  clash AS MATERIALIZED (SELECT a.doc_id, a.n AS a, b.n AS b FROM (SELECT *, unnest(range(start, stop)) AS c FROM free) a JOIN (SELECT *, unnest(range(start, stop)) AS c FROM free) b ON a.doc_id = b.doc_id AND a.c = b.c AND a.n < b.n GROUP BY ALL),
  {_decided(8)},
  kept AS (SELECT doc_id, name, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM free JOIN s8 USING (doc_id, n) WHERE kept),
  done AS (SELECT doc_id, string_agg(text[before + 1:start] || '[' || name || '](' || lower(replace(name, ' ', '-')) || '.md)', '' ORDER BY start) AS t, max(stop) AS stop FROM kept JOIN documents USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, CASE WHEN t IS NULL THEN text ELSE t || text[stop + 1:] END AS t FROM documents LEFT JOIN done USING (doc_id)""")
def x37_table(spark, sf_dir):
    """Names of a table, of one word or several, as links in every text."""
    found = names(spark, sf_dir).select("name").distinct()
    links = found.select("name", F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("-"))), F.lit(".md")).alias("target"))
    return references.enriched(_docs(spark, sf_dir).withColumnRenamed("doc_id", "id"), links).select(F.col("id").alias("doc_id"), "t")


@R.query("x38_clean_page", _on("""SELECT doc_id, '# Title' || chr(10) || chr(10) || trim(array_to_string(list_filter(string_split(t, chr(10)), lambda x: lower(trim(regexp_replace(x, '^\\s*#\\s*', ''))) <> 'title'), chr(10))) AS t
  FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(t), '^```markdown[\\r\\n]*', ''), '\\s*```$', ''), '(?is)<details>\\s*<summary>\\s*Relevant source files\\s*</summary>.*?</details>', '', 'g')) AS t FROM tx)"""))
def x38(spark, sf_dir):
    """Generated pages without fences, source lists and repeated titles."""
    return _texts(spark, sf_dir).select("doc_id", prose.clean_page(F.col("t"), F.lit("Title")).alias("t"))


def _number(pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(trim(t), {_q(pattern)}, 1), '') AS DOUBLE)"


@R.query("x39_score_parser", _on(f"""SELECT doc_id, greatest(0, least(1, coalesce({_number(prose.PERCENT)} / 100.0::DOUBLE, {_number(prose.NAMED)}, {_number(prose.GIVEN)},
  list_filter([TRY_CAST(x AS DOUBLE) FOR x IN regexp_extract_all(trim(t), {_q(prose.BARE)}, 1)], lambda x: abs(x) <= 1.5)[1],
  CASE WHEN starts_with(lower(trim(t)), 'yes') OR contains(lower(trim(t)), chr(10) || 'yes') THEN 1 WHEN starts_with(lower(trim(t)), 'no') OR contains(lower(trim(t)), chr(10) || 'no') THEN 0 END, 0.5)))::DOUBLE AS score FROM tx"""))
def x39(spark, sf_dir):
    """A judge's answer as a number from 0 to 1."""
    return _texts(spark, sf_dir).select("doc_id", prose.score(F.col("t")).alias("score"))


@_both("x40_json_salvage", "SELECT doc_id, nullif(regexp_extract(regexp_replace(t, '```(?:json)?', '', 'g'), '(?s)(\\{.*\\})', 1), '') AS body FROM tx")
def x40(t):
    """From the first to the last brace."""
    return [prose.salvage_json(t).alias("body")]


@R.query("x41_mermaid_block", _on("SELECT doc_id, CASE WHEN b <> '' THEN trim(b) ELSE trim(t) END AS block FROM (SELECT doc_id, t, regexp_extract(t, '(?s)```(?:mermaid)?\\s*\\n(.*?)```', 1) AS b FROM tx)"))
def x41(spark, sf_dir):
    """The first fenced block, else all of it."""
    return _texts(spark, sf_dir).select("doc_id", prose.mermaid(F.col("t")).alias("block"))


@_both("x42_requirement_key", "SELECT doc_id, trim(replace(replace(replace(lower(t), '.', ''), ',', ''), ';', '')) AS key FROM tx")
def x42(t):
    """Lower case without full stops, commas and semicolons."""
    return [prose.requirement_key(t).alias("key")]


_CATEGORY = "CASE WHEN regexp_matches(lower(t), 'example|code|sample') THEN 'Code Examples' WHEN regexp_matches(lower(t), 'api|endpoint|method') THEN 'API Coverage' WHEN regexp_matches(lower(t), 'structure|organization|format') THEN 'Structure & Organization' ELSE 'Documentation Quality' END"


@_both("x43_requirement_category", f"SELECT doc_id, {_CATEGORY} AS category FROM tx")
def x43(t):
    """One of four kinds of requirement."""
    return [prose.requirement_category(t).alias("category")]


@R.query("x45_section_order", "SELECT n_name AS title, row_number() OVER (ORDER BY CASE WHEN contains(lower(n_name), 'nation_2') THEN 1 ELSE 5 END, lower(n_name)) AS place FROM nation")
def x45(spark, sf_dir):
    """Sections by priority, then title."""
    from pyspark.sql.window import Window

    title = F.replace("n_name", F.lit("NATION_2"), F.lit("overview"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.row_number().over(Window.orderBy(prose.section_priority(title), F.lower("n_name"))).cast("long").alias("place"))


@R.query("x46_output_agreement", """SELECT conv_id, round(a, 9) AS agreement, round((1 - a) * greatest(0.5, 1 - (n - 1) * 0.1), 9) AS uncertainty FROM
  (SELECT conv_id, count(*) AS n, CASE WHEN count(*) < 2 THEN 1 ELSE greatest(0, least(1, 1 - stddev_pop(length(text)) / avg(length(text)))) END AS a FROM conversations GROUP BY conv_id)""")
def x46(spark, sf_dir):
    """Agreement of outputs by the spread of their lengths."""
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.avg(n).alias("m"), F.stddev_pop(n).alias("s"), F.count("*").alias("n"))
    agreed = prose.agreement(F.col("m"), F.col("s"), F.col("n"))
    return rows.select("conv_id", F.round(agreed, 9).alias("agreement"), F.round(prose.uncertainty(agreed, F.col("n")), 9).alias("uncertainty"))


_AGENT = f"""ag AS (SELECT doc_id, length(t) // 4 AS tokens, list_sum([{' + '.join(f"contains(x, {_q(m)})::INT" for m in code.AGENT_MARKS)} for x in regexp_split_to_array(t, '[\\r\\n]') if trim(x) <> '']) AS marks,
  list_max([(length(x) - length(ltrim(x))) // 4 for x in regexp_split_to_array(t, '[\\r\\n]') if trim(x) <> '']) AS nesting FROM tx)"""


@R.query("x47_agent_complexity", _on("SELECT doc_id, tokens, marks::INT AS marks, nesting::INT AS nesting FROM ag", _AGENT))
def x47(spark, sf_dir):
    """Tokens, marked lines and indentation as the agents see them."""
    tokens, marks, nesting = code.agent_metrics(F.col("t"))
    return _texts(spark, sf_dir).select("doc_id", tokens.alias("tokens"), marks.alias("marks"), nesting.alias("nesting"))


@R.query("x48_agent_delegation", _on("SELECT doc_id, CASE WHEN doc_id % 20 = 1 THEN 'none' WHEN tokens > 2000 THEN 'tokens' WHEN marks > 10 THEN 'complexity' ELSE 'none' END AS reason FROM ag", _AGENT))
def x48(spark, sf_dir):
    """Whether an agent hands on, unless it was handed to."""
    tokens, marks, _ = code.agent_metrics(F.col("t"))
    reason = code.agent_delegates(tokens, marks, F.col("doc_id") % 20 == 1)
    return _texts(spark, sf_dir).select("doc_id", reason.alias("reason"))


@R.query("x49_key_topics", _on("""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: starts_with(ltrim(x), '## ') OR starts_with(ltrim(x), '### '))[1:5], lambda x: regexp_replace(x, '^[# ]+', '')), ',') AS topics FROM tx"""))
def x49(spark, sf_dir):
    """The first five headers of level two and three."""
    return _texts(spark, sf_dir).select("doc_id", F.array_join(prose.key_topics(F.col("t")), ",").alias("topics"))


@_both("x50_concrete_details", "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, '`([^`]+)`', 1), lambda x: length(x) > 2 AND length(x) < 50 AND NOT contains(x, chr(10))), ',') AS details FROM tx")
def x50(t):
    """Short spans between backticks."""
    return [F.array_join(prose.concrete_details(t), ",").alias("details")]


@_both("x51_citations", "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, '\\[{1,2}\\s*(\\d+)\\s*\\]{1,2}', 1), lambda x: x::INT BETWEEN 1 AND 1), ',') AS cited FROM tx")
def x51(t):
    """Citation marks that name a source."""
    return [F.array_join(prose.citations(t, F.lit(1)).cast("array<string>"), ",").alias("cited")]


@_both("x52_line_names", f"SELECT doc_id, array_to_string(regexp_extract_all(t, {_q('(?m)' + code.FUNCTION_NAMES['python'])}, 1), ',') AS functions, array_to_string(regexp_extract_all(t, {_q('(?m)' + code.CLASS_NAMES['python'])}, 1), ',') AS classes FROM tx")
def x52(t):
    """Function and class names at the start of lines."""
    return [F.array_join(code.line_names(t, code.FUNCTION_NAMES["python"]), ",").alias("functions"), F.array_join(code.line_names(t, code.CLASS_NAMES["python"]), ",").alias("classes")]


@_both("x53_usage_counts", f"SELECT doc_id, {_count('t', code.INHERITANCE['javascript'])} AS inheritance, {_count('t', code.ACCESS['python'])} AS access, {_count('t', code.IMPORT_LINES['python'])} AS imports FROM tx")
def x53(t):
    """Inheritance, attribute access and imports."""
    return [code.matches(t, p).alias(n) for n, p in (("inheritance", code.INHERITANCE["javascript"]), ("access", code.ACCESS["python"]), ("imports", code.IMPORT_LINES["python"]))]


@_both("x54_imported_modules", f"SELECT doc_id, array_to_string(regexp_extract_all(t, {_q(code.IMPORTED['python'])}, 1)[1:10], ',') AS modules FROM tx")
def x54(t):
    """The first ten imported modules."""
    return [F.array_join(F.slice(F.regexp_extract_all(t, F.lit(code.IMPORTED["python"]), F.lit(1)), 1, 10), ",").alias("modules")]


@R.query("x55_entry_lines", _on(f"""SELECT doc_id, i AS line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM tx)
  WHERE regexp_matches(x, {_q(code.ENTRY_LINES['python'][1][1])}) OR regexp_matches(x, {_q(code.ENTRY_LINES['python'][2][1])})"""))
def x55(spark, sf_dir):
    """Lines that match an entry pattern of the language."""
    rows = _texts(spark, sf_dir).select("doc_id", F.explode(code.entry_lines(F.col("t"), "python")).alias("e"))
    return rows.select("doc_id", F.col("e.line").cast("long").alias("line"))


@_both("x56_qualified_names", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(t, {_q(code.QUALIFIED)}, 1), lambda x: x NOT IN ('this', 'console'))[1:5], ',') AS names FROM tx")
def x56(t):
    """The first five qualifiers of names."""
    return [F.array_join(code.qualified_names(t), ",").alias("names")]


_SEG = "string_split(file_path, '/')"


@R.query("s02_ignored_in_graph", on_graph(f"SELECT node_id, len(list_filter({_SEG}, lambda s: lower(s) IN ({', '.join(_q(x) for x in code.GRAPH_IGNORED)}) OR starts_with(s, '.'))) > 0 AS ignored FROM p", "p AS (SELECT node_id, CASE complexity WHEN 1 THEN 'a/Bin/x.cs' WHEN 2 THEN '.git/x' ELSE file_path END AS file_path FROM nodes)"))
def s02(spark, sf_dir):
    """Paths that graphs leave out."""
    path = F.when(F.col("complexity") == 1, "a/Bin/x.cs").when(F.col("complexity") == 2, ".git/x").otherwise(F.col("file_path"))
    return model.nodes(spark, sf_dir).select("node_id", code.ignored_in_graph(path).alias("ignored"))


@R.query("s03_ignored_component", on_graph(f"SELECT node_id, len(list_filter({_SEG}, lambda s: lower(s) IN ({', '.join(_q(x) for x in code.COMPONENT_IGNORED)}))) > 0 OR file_path LIKE '%.tmp' AS ignored FROM p", "p AS (SELECT node_id, CASE complexity WHEN 1 THEN 'a/Debug/x.cs' WHEN 2 THEN 'b/x.TMP' WHEN 3 THEN 'c/x.tmp' ELSE file_path END AS file_path FROM nodes)").replace("LIKE '%.tmp'", "ILIKE '%.tmp'"))
def s03(spark, sf_dir):
    """Paths that components leave out: another list."""
    c = F.col("complexity")
    path = F.when(c == 1, "a/Debug/x.cs").when(c == 2, "b/x.TMP").when(c == 3, "c/x.tmp").otherwise(F.col("file_path"))
    return model.nodes(spark, sf_dir).select("node_id", code.ignored_component(path).alias("ignored"))


@R.query("s04_infrastructure_files", on_graph(f"""SELECT node_id, lower(string_split(p, '/')[-1]) IN ({', '.join(_q(x) for x in code.INFRASTRUCTURE)}) OR regexp_matches(lower(string_split(p, '/')[-1]), '^(\\.eslintrc|\\.prettierrc)') OR regexp_matches(lower(p), '\\.(sln|csproj)$') AS infra
  FROM (SELECT node_id, CASE complexity WHEN 1 THEN 'src/Package.json' WHEN 2 THEN 'a/.eslintrc.cjs' WHEN 3 THEN 'x.CSPROJ' ELSE file_path END AS p FROM nodes)"""))
def s04(spark, sf_dir):
    """Files of build and configuration."""
    c = F.col("complexity")
    path = F.when(c == 1, "src/Package.json").when(c == 2, "a/.eslintrc.cjs").when(c == 3, "x.CSPROJ").otherwise(F.col("file_path"))
    return model.nodes(spark, sf_dir).select("node_id", code.is_infrastructure(path).alias("infra"))


_LANG = "CASE WHEN file_path LIKE '%.java' THEN 'Java' WHEN file_path LIKE '%.cs' THEN 'C#' WHEN file_path LIKE '%.py' THEN 'Python' ELSE '{}' END"


@R.query("s05_graph_language", on_graph(f"SELECT node_id, {_LANG.format('Unknown')} AS language FROM nodes"))
def s05(spark, sf_dir):
    """Language by extension, for graphs."""
    return _paths(spark, sf_dir).select("node_id", code.language(F.col("file_path")).alias("language"))


@R.query("s06_component_language", on_graph(f"SELECT node_id, {_LANG.format('None')} AS language FROM nodes"))
def s06(spark, sf_dir):
    """Language by extension, for components."""
    return _paths(spark, sf_dir).select("node_id", code.language(F.col("file_path"), code.COMPONENT_LANGUAGES, "None").alias("language"))


@R.query("s07_repository_profile", on_graph("""SELECT count(*) AS files, count(DISTINCT regexp_replace(file_path, '/[^/]*$', '')) AS directories, (SELECT CASE e WHEN 'cs' THEN 'C#' WHEN 'java' THEN 'Java' WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' ELSE 'Mixed' END
  FROM (SELECT lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS e, count(*) AS n FROM nodes GROUP BY 1) WHERE e IN ('cs', 'java', 'py', 'js', 'ts', 'cpp', 'c', 'go', 'rs') ORDER BY n DESC, e LIMIT 1) AS language FROM nodes"""))
def s07(spark, sf_dir):
    """Files, directories and the prevailing language; ties by extension."""
    rows = _paths(spark, sf_dir)
    top = rows.filter(code.extension(F.col("file_path")).isin(*code.COMPONENT_LANGUAGES)).groupBy(code.extension(F.col("file_path")).alias("e")).agg(F.count("*").alias("n"))
    top = top.agg(F.min(F.struct((-F.col("n")).alias("k"), "e"))["e"].alias("e"))
    main = {k: code.COMPONENT_LANGUAGES[k] for k in ("cs", "java", "py", "js", "ts")}
    one = rows.agg(F.count("*").alias("files"), F.countDistinct(F.regexp_replace("file_path", "/[^/]*$", "")).alias("directories")).crossJoin(F.broadcast(top))
    return one.select("files", "directories", code.language(F.concat(F.lit("x."), "e"), main, "Mixed").alias("language"))


@R.query("a40_extension_histogram", on_graph("SELECT regexp_extract(file_path, '\\.([^./]+)$', 1) AS extension, count(*) AS n FROM nodes GROUP BY 1"))
def a40(spark, sf_dir):
    """Files of each extension."""
    return _paths(spark, sf_dir).groupBy(code.extension(F.col("file_path")).alias("extension")).agg(F.count("*").alias("n"))
