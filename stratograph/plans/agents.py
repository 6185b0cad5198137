"""Queries over files, parsers, stores and orchestration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code, prose
from ..operators import agents, references, retrieval, syntax
from ..registry import Registry
from ..sources import model, parse, stores, tables
from ..sources.tables import scratch, table
from ..streaming import events as streams
from .bindings import OCCURRENCES, names, on_graph
from .text import _count, _on, _q, _texts

R = Registry()


# files


def _line_digest(line):
    """A number of a line, to be summed in any order."""
    return F.conv(F.substring(F.md5(F.encode(line, "utf-8")), 1, 8), 16, 10).cast("long")


_LINE_DIGEST = "sum(('0x' || md5(line)[1:8])::BIGINT)::BIGINT"


@R.query("s01_source_scan", f"SELECT lang, sum(strlen(line) + 1)::BIGINT AS bytes, count(*) AS lines, {_LINE_DIGEST} AS digest FROM (SELECT lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY lang")
def s01(spark, sf_dir):
    """Source files found below a folder, texts of each language in files of bounded size; every line is read back."""
    path = scratch(spark, "tree")
    stores.write_files(table(spark, sf_dir, "documents"), path, "lang", "text", ".py")
    files = tables.source_files(spark, path)
    lines = files.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.count("*").alias("lines"), F.sum(_line_digest(F.col("line"))).alias("digest"))


@R.query("s15_markdown_scan", "SELECT item_id, strlen(text) + 1 AS bytes FROM benchmark WHERE strlen(text) + 1 <= 250")
def s15(spark, sf_dir):
    """Markdown files of a module, the long ones left out."""
    path = scratch(spark, "markdown")
    stores.write_files(table(spark, sf_dir, "benchmark"), path, "item_id", "text", ".md")
    found = tables.markdown_context(spark, path, 250)
    return found.select(F.regexp_extract("path", "item_id=([^/]+)/", 1).cast("long").alias("item_id"), F.octet_length("content").cast("long").alias("bytes"))


@R.query("s16_page_sink", f"SELECT lang AS audience, sum(strlen(line) + 1)::BIGINT AS bytes, count(*) AS lines, {_LINE_DIGEST} AS digest FROM (SELECT lang, unnest(string_split('# Page ' || doc_id || chr(10) || coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY lang")
def s16(spark, sf_dir):
    """Pages written as Markdown, a folder for each audience, and every line of them read back."""
    path = scratch(spark, "pages")
    pages = model.pages(spark, sf_dir).select(F.col("language").alias("audience"), "title", F.coalesce("content", F.lit("")).alias("content"))
    tables.write_text(pages, path)
    lines = spark.read.option("lineSep", "\n").schema("value string, audience string").text(path)
    return lines.groupBy("audience").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count("*").alias("lines"), F.sum(_line_digest(F.col("value"))).alias("digest"))


@R.query("s17_diagram_export", on_graph("""SELECT region, '<!DOCTYPE html>' || chr(10) || '<html><head><title>' || region || '</title></head>' || chr(10) || '<body><pre class="mermaid">' || chr(10) || 'graph TD' || chr(10)
  || string_agg(line, chr(10) ORDER BY line) || chr(10) || '</pre></body></html>' AS page FROM (SELECT dst AS region, '  ' || regexp_replace(src, '[^A-Za-z0-9]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9]', '_', 'g') AS line
  FROM edges WHERE type = 'ChildOf') GROUP BY region"""))
def s17(spark, sf_dir):
    """Diagrams as HTML pages, a file each, read back."""
    edges = model.graph(spark, sf_dir).edges.filter("type = 'ChildOf'").withColumn("region", F.col("dst"))
    rows = stores.mermaid_diagrams(edges, "region").select("region", stores.diagram_page(F.col("region"), F.col("body")).alias("page"))
    path = scratch(spark, "diagrams")
    stores.write_files(rows, path, "region", "page", ".html")
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("page", F.regexp_replace("value", "\n$", ""))
    return files.select(F.regexp_extract("page", "<title>([^<]+)<", 1).alias("region"), "page")


@R.query("s18_debug_snapshots", "SELECT event_type AS step, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1")
def s18(spark, sf_dir):
    """Failures appended as JSON in two writes and read back."""
    rows, path = table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), "props"), scratch(spark, "snapshots")
    tables.append_json(rows.filter("step = 'error'"), path)
    tables.append_json(rows.filter("step = 'click'"), path)
    return spark.read.schema("step string, props string").json(path).groupBy("step").agg(F.count("*").alias("n"))


@R.query("s12_sqlite_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s12(spark, sf_dir):
    """A keyed table through a SQLite file and back."""
    stores.use_sqlite(spark)
    path = scratch(spark, "sqlite") + ".db"
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    rows.write.format("sqlite").options(path=path, table="supplier").mode("append").save()
    return spark.read.format("sqlite").options(path=path, table="supplier").load()


# parsers


def _files(spark, sf_dir):
    """Every whole text and its snippet as a C# file."""
    return _texts(spark, sf_dir).select(F.concat(F.lit("src/"), "doc_id", F.lit(".cs")).alias("path"), F.col("t").alias("content"))


@R.query("s09_parsed_files", _on("SELECT 'src/' || doc_id || '.cs' AS file_path, length(t) - length(replace(t, chr(10), '')) + 1 AS line_count FROM tx"))
def s09(spark, sf_dir):
    """The file nodes that the parser makes of every text."""
    nodes, _ = parse.parsed(_files(spark, sf_dir))
    return nodes.filter("type = 'File'").select("file_path", F.col("line_count").cast("long").alias("line_count"))


def _lines_alone(path: str, lang: str, text: str):
    if not text:
        raise ValueError("empty file")
    return [(path, "File", path, text.count("\n") + 1, len(text))], []


@R.query("s08_u02_pluggable_parser", _on("SELECT 'src/' || doc_id || '.cs' AS file_path, length(t) AS complexity FROM tx"))
def u02(spark, sf_dir):
    """Another parser in place of the light one, tried again where it fails."""
    nodes, _ = parse.parsed(_files(spark, sf_dir), {"C#": _lines_alone})
    return nodes.select("file_path", F.col("complexity").cast("long").alias("complexity"))


def _sources(spark, sf_dir):
    """Every whole text and its snippet as a file of one of three languages."""
    i = F.pmod("doc_id", F.lit(3)).cast("int")
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), i)
    path = F.concat(F.lit("src/"), "doc_id", F.lit("."), pick("cs", "js", "java"))
    return _texts(spark, sf_dir).select(path.alias("path"), pick("C#", "JavaScript", "Java").alias("language"), F.col("t").alias("content"))


def _of(list_: str, *words: str) -> str:
    return f"len(list_filter({list_}, lambda x: x IN ({', '.join(map(_q, words))})))"


_NOT = ", ".join(map(_q, syntax.CONTROL))
_RUN = "PARTITION BY path ORDER BY"
#: Statements s, types y with their spans, members m with theirs, by joins on spans.
_SYNTAX = (
    "f AS (SELECT 'src/' || doc_id || '.' || (['cs', 'js', 'java'])[doc_id % 3 + 1] AS path, (['C#', 'JavaScript', 'Java'])[doc_id % 3 + 1] AS language, t FROM tx)",
    f"k AS (SELECT path, language, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT path, language, regexp_extract_all(t, {_q(syntax.DIRECTIVES)}) AS w FROM f WHERE language = 'C#' UNION ALL SELECT path, language, regexp_extract_all(t, {_q(syntax.BRACES)}) FROM f WHERE language <> 'C#'))",
    f"l AS (SELECT *, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER ({_RUN} i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM k)",
    f"n AS (SELECT *, sum((tok = '{{')::INT - (tok = '}}')::INT) OVER w AS level, sum((tok = '(')::INT - (tok = ')')::INT) OVER w AS depth FROM l WHERE tok <> chr(10) AND NOT regexp_matches(tok, {_q(syntax.COMMENT)}) WINDOW w AS ({_RUN} i))",
    "o AS (SELECT *, tok IN ('{', '}') OR (tok = ';' AND depth <= coalesce(last_value(CASE WHEN tok = '{' THEN depth END IGNORE NULLS) OVER (PARTITION BY path, level ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS b FROM n)",
    f"p AS (SELECT *, coalesce(sum(b::INT) OVER ({_RUN} i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq FROM o)",
    rf"""q AS (SELECT path, language, seq, coalesce(string_agg(CASE WHEN NOT b THEN CASE WHEN regexp_matches(tok, {_q(syntax.STRING)}) THEN '""' ELSE tok END END, ' ' ORDER BY i), '') AS head, coalesce(max(CASE WHEN b THEN tok END), '') AS ends, min(line) AS line, max(line) AS last_line FROM p GROUP BY ALL)""",
    f"r AS (SELECT *, regexp_replace(head, {_q(syntax.ATTRIBUTES)}, '') AS bare, string_split(head, ' ') AS words, sum(CASE ends WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER ({_RUN} seq) AS level, lead(head) OVER ({_RUN} seq) AS following, max(seq) OVER (PARTITION BY path) AS top FROM q)",
    "s AS (SELECT r.*, CASE WHEN ends = '{' THEN coalesce(stop, top) END AS stop FROM r LEFT JOIN (SELECT o.path, o.seq, min(c.seq) AS stop FROM r o JOIN r c ON c.path = o.path AND o.ends = '{' AND c.ends = '}' AND c.level + 1 = o.level AND c.seq > o.seq GROUP BY o.path, o.seq) USING (path, seq))",
    rf"y AS (SELECT *, regexp_extract(bare, {_q(syntax.TYPE)}, 1) AS word, regexp_extract(bare, {_q(syntax.TYPE)}, 2) AS name FROM s WHERE regexp_matches(bare, {_q(syntax.TYPE)}) AND (ends = '{{' OR (ends = ';' AND regexp_matches(bare, '(^| )record .*\)( : .*)?$'))))",
    """u AS (SELECT s.*, home FROM s LEFT JOIN (SELECT s.path, s.seq, max_by((y.name, y.level), y.seq) AS home FROM s JOIN y ON y.path = s.path AND y.ends = '{' AND y.seq < s.seq AND s.seq <= y.stop GROUP BY s.path, s.seq) USING (path, seq))""",
    rf"""v AS (SELECT u.*, home[2] = level - (ends = '{{')::INT + (ends = '}}')::INT AS direct, regexp_extract(bare, {_q(syntax.NAMED)}, 1) AS before, regexp_extract(bare, {_q(syntax.NAMED)}, 2) AS called, language = 'JavaScript' AS script,
      {_of('words', '(')} = {_of('words', ')')} AS even, (path, seq) IN (SELECT (path, seq) FROM y) AS typed FROM u)""",
    rf"""w AS (SELECT *, called <> '' AND called NOT IN ({_NOT}) AND even AND NOT typed AND NOT regexp_matches(before, '(^| )(new|return|throw|await|yield|else|case|if|for|while) |[.?+\-/!]') AS fit, regexp_matches(before, '([\p{{L}}\p{{N}}_$>\]*&?]| ::) $') AS typing, regexp_extract(bare, {_q(syntax.ASSIGNED)}, 1) AS given, regexp_matches(bare, '\) =>') AS arrow FROM v)""",
    rf"""m AS (SELECT *, CASE WHEN typed THEN NULL WHEN ends = '{{' AND script AND given <> '' THEN given WHEN ends = '{{' AND regexp_matches(before, '(^| )function (\* )?$') AND fit THEN called WHEN ends = '{{' AND direct AND fit THEN called
      WHEN ends = '{{' AND NOT script AND fit AND typing AND (level = 1 OR home IS NULL) THEN called
      WHEN ends = ';' AND direct AND called <> '' AND called NOT IN ({_NOT}) AND NOT regexp_matches(before, '(^| )(new|return|throw) |[.?]') AND (typing OR script OR arrow) AND (even OR arrow) THEN called END AS member FROM w)""",
    """a AS (SELECT m.*, inside FROM m LEFT JOIN (SELECT m.path, m.seq, max(h.seq) AS inside FROM m JOIN m h ON h.path = m.path AND h.member IS NOT NULL AND h.ends = '{' AND h.seq < m.seq AND m.seq <= h.stop GROUP BY m.path, m.seq) USING (path, seq))""",
    rf"""b AS (SELECT *, inside IS NOT NULL AND NOT script AND member IS NOT NULL AND NOT coalesce(direct, false) AS nested, CASE WHEN coalesce(direct, false) THEN home[1] ELSE nullif(regexp_extract(before, '([\p{{L}}_$][\p{{L}}\p{{N}}_$]*) :: $', 1), '') END AS scope,
      CASE WHEN member IS NULL AND NOT typed THEN nullif(CASE WHEN ends = '{{' AND direct AND NOT regexp_matches(bare, '[()=]') AND regexp_matches(following, {_q(syntax.ACCESSOR)}) THEN regexp_extract(bare, '([\p{{L}}_$][\p{{L}}\p{{N}}_$]*)$', 1)
        WHEN ends = ';' AND direct AND language = 'C#' AND regexp_matches(bare, '^[^()=]* =>') THEN regexp_extract(bare, '([\p{{L}}_$][\p{{L}}\p{{N}}_$]*) =>', 1) END, '') END AS field FROM a)""",
    rf"""d AS (SELECT b.*, coalesce(y.word, CASE WHEN member IS NOT NULL AND NOT nested THEN CASE WHEN scope IS NULL THEN 'Function' WHEN member IN ('constructor', '__init__') OR member = home[1] THEN 'Constructor' ELSE 'Method' END END, CASE WHEN field IS NOT NULL THEN 'Property' END) AS kind, coalesce(y.name, CASE WHEN NOT nested THEN member END, field) AS own,
      {_of('b.words', 'if', 'elif', 'for', 'foreach', 'while', '&&', '||')} + 2 * {_of('b.words', 'switch')} + least({_of('b.words', '?')}, {_of('b.words', ':')}) AS points, {_of('b.words', 'if', 'elif', 'for', 'foreach', 'while', 'case', 'catch', 'except')} AS walk FROM b LEFT JOIN y USING (path, seq))""",
)


@R.query("s09_syntax_elements", _on("""SELECT d.path, d.kind, d.own AS name, CASE WHEN d.kind IN ('Method', 'Constructor', 'Property') THEN d.scope END AS owner, d.line::BIGINT AS line, max(coalesce(e.last_line, d.last_line))::BIGINT AS end_line,
  1 + coalesce(sum(e.points + (coalesce(e.kind, '') IN ('Method', 'Property'))::INT), 0)::BIGINT AS complexity, 1 + coalesce(sum(e.walk), 0)::BIGINT AS walk
  FROM d LEFT JOIN d e ON e.path = d.path AND d.ends = '{' AND e.seq > d.seq AND e.seq <= d.stop WHERE d.kind IS NOT NULL GROUP BY d.path, d.seq, d.kind, d.own, d.scope, d.line""", *_SYNTAX))
def s09_elements(spark, sf_dir):
    """Types and members of every text as a source file, with spans and complexity."""
    found = syntax.elements(syntax.blocks(syntax.statements(_sources(spark, sf_dir))))
    kind = F.when(syntax.is_type_name(F.col("kind")), F.lower("kind")).otherwise(F.col("kind"))
    return found.select("path", kind.alias("kind"), "name", "owner", *[F.col(c).cast("long").alias(c) for c in ("line", "end_line", "complexity", "walk")])


_CHUNKS = (
    "e AS (SELECT d.path, d.path || '::' || CASE WHEN d.kind IN ('Method', 'Constructor', 'Property') AND d.scope IS NOT NULL THEN d.scope || '.' ELSE '' END || d.own AS id, d.line, coalesce(c.last_line, d.last_line) AS end_line FROM d LEFT JOIN d c ON c.path = d.path AND d.ends = '{' AND c.seq = d.stop WHERE d.kind IS NOT NULL)",
    "g AS (SELECT path, unnest(string_split(t, chr(10))) AS text, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM f)",
    "h AS (SELECT g.path, g.line, any_value(text) AS text, coalesce(max((e.line, -e.end_line, e.id))[3], g.path) AS own FROM g LEFT JOIN e ON e.path = g.path AND g.line BETWEEN e.line AND e.end_line GROUP BY g.path, g.line)",
    "i AS (SELECT *, sum(change) OVER (PARTITION BY path ORDER BY line) AS run FROM (SELECT *, CASE WHEN lag(own) OVER (PARTITION BY path ORDER BY line) = own THEN 0 ELSE 1 END AS change FROM h))",
    "j AS (SELECT *, length(text) + 1 AS size, row_number() OVER (PARTITION BY path, run ORDER BY line) AS nth FROM i)",
    "z AS (SELECT path, run, nth, 0 AS chunk, size AS used FROM j WHERE nth = 1 UNION ALL SELECT j.path, j.run, j.nth, chunk + ((used + size) // 4 > 40)::INT, CASE WHEN (used + size) // 4 > 40 THEN size ELSE used + size END FROM z JOIN j ON j.path = z.path AND j.run = z.run AND j.nth = z.nth + 1)",
)


@R.query("v07_code_chunks", _on("SELECT path, own AS component_id, min(line)::BIGINT AS start_line, max(line)::BIGINT AS end_line, sha256(string_agg(text, chr(10) ORDER BY line)) AS text_sha256 FROM z JOIN j USING (path, run, nth) GROUP BY path, own, run, chunk HAVING trim(string_agg(text, chr(10) ORDER BY line)) <> ''", *_SYNTAX, *_CHUNKS).replace("WITH ", "WITH RECURSIVE ", 1))
def v07_code(spark, sf_dir):
    """Chunks of every text as a source file, cut along types and members."""
    files = _sources(spark, sf_dir)
    found = retrieval.code_chunks(files, syntax.elements(syntax.blocks(syntax.statements(files))), 40)
    return found.select("path", "component_id", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")], F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


@R.query("x44_declared_attributes", _on(r"""SELECT d.path, d.own AS name, d.line::BIGINT AS line, array_to_string(list_transform(regexp_extract_all(d.head, '@ ([\p{L}\p{N}_$]+( \. [\p{L}\p{N}_$]+)*)', 1), lambda x: replace(x, ' ', '')), ',') AS attributes
  FROM d WHERE d.kind IS NOT NULL AND d.language <> 'C#'""", *_SYNTAX))
def x44_attributes(spark, sf_dir):
    """Decorators and annotations of what scripts and Java files declare."""
    found = syntax.elements(syntax.blocks(syntax.statements(_sources(spark, sf_dir)))).filter("language <> 'C#'")
    return found.select("path", "name", F.col("line").cast("long").alias("line"), F.array_join("attributes", ",").alias("attributes"))


_CODE = f"cd AS (SELECT doc_id, t, regexp_replace(t, {_q(code.BLANKS)}, ' ', 'g') AS c FROM tx)"


@R.query("x02_type_complexity", _on(f"""SELECT doc_id, 1 + {_count('c', code.TYPE_POINTS)} + 2 * {_count('c', code.SWITCH)} + {_count('c', code.LOGICAL)} + {_count('c', code.TERNARY)}
  + len(list_filter(regexp_extract_all(c, {_q(code.METHOD)}, 1), lambda x: x NOT IN ({', '.join(map(_q, code.NO_METHOD))}))) + {_count('c', code.PROPERTY)} AS complexity FROM cd""", _CODE))
def x02(spark, sf_dir):
    """Decision points, operators, methods and properties of a type's source."""
    return _texts(spark, sf_dir).select("doc_id", code.type_complexity(F.col("t")).cast("long").alias("complexity"))


@R.query("x03_walker_complexity", _on(f"SELECT doc_id, 1 + {_count('c', code.WALKER)} AS complexity FROM cd", _CODE))
def x03(spark, sf_dir):
    """Branches, loops, cases and catches."""
    return _texts(spark, sf_dir).select("doc_id", code.walker_complexity(F.col("t")).cast("long").alias("complexity"))


@R.query("x04_script_complexity", _on(f"SELECT doc_id, 1 + {_count('c', code.SCRIPT_POINTS)} + {_count('c', code.TERNARY)} + 2 * {_count('c', code.LOGICAL)} + {_count('c', code.BIT_AND)} AS complexity FROM (SELECT doc_id, regexp_replace(c, '[ªµºÀ-ÖØ-öø-ɏ]', 'x', 'g') AS c FROM cd)", _CODE))
def x04(spark, sf_dir):
    """Decision nodes of a script, logical operators counted twice."""
    return _texts(spark, sf_dir).select("doc_id", code.script_complexity(F.col("t")).cast("long").alias("complexity"))


@R.query("x44_elements", _on(f"""SELECT doc_id, array_to_string(regexp_extract_all(t, {_q(code.DECORATOR)}, 1), ',') AS decorators, array_to_string(regexp_extract_all(t, {_q(code.IMPORTED['java'])}, 1), ',') AS imports,
  array_to_string(regexp_extract_all(t, {_q('(?i)' + code.GENERIC_CLASSES[0])}, 1), ',') AS classes FROM tx"""))
def x44(spark, sf_dir):
    """Decorators, imports and classes of each text."""
    t = F.col("t")
    found = {"decorators": code.DECORATOR, "imports": code.IMPORTED["java"], "classes": "(?i)" + code.GENERIC_CLASSES[0]}
    return _texts(spark, sf_dir).select("doc_id", *[F.array_join(F.regexp_extract_all(t, F.lit(p), F.lit(1)), ",").alias(k) for k, p in found.items()])


@R.query("j09_dictionary_links", f"WITH {OCCURRENCES} SELECT doc_id, lower(name) || '.md' AS target, count(*) AS n FROM occurrences GROUP BY ALL")
def j09(spark, sf_dir):
    """Pages that each text refers to by a name of the dictionary."""
    known = names(spark, sf_dir).select("name").distinct()
    found = references.counted(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")), known)
    links = known.select("name", F.concat(F.lower("name"), F.lit(".md")).alias("target"))
    return found.join(links, "name").groupBy(F.col("id").alias("doc_id"), "target").agg(F.sum("n").alias("n"))


# stores and orchestration


@R.query("s13_u04_vector_store", "SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label <> 4 ORDER BY 2 LIMIT 5")
def u04(spark, sf_dir):
    """A collection created, filled twice, thinned by payload and searched."""
    rows = model.vectors(spark, sf_dir)
    documents = rows.select("doc_id", "embedding", F.concat(F.lit("text "), "doc_id").alias("text"), F.create_map(F.lit("label"), F.col("label")).alias("payload"))
    store = stores.VectorStore(spark, scratch(spark, "vectors"))
    store.create("pages", 64)
    store.upsert("pages", documents)
    store.upsert("pages", documents.filter("doc_id % 2 = 0"))
    store.delete("pages", {"label": "4"})
    query = [float(x) for x in rows.filter("doc_id = 0").first()["embedding"]]
    return store.search("pages", query, 5).select("doc_id", F.col("rank").cast("long").alias("rank"))


_CONTEXTS = "x AS (SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE 'system of ' || conv_id END AS system, CASE WHEN conv_id % 4 = 1 THEN NULL ELSE 'summary of ' || conv_id END AS text, conv_id % 5 <> 2 AS flag, conv_id % 7 <> 3 AS data FROM (SELECT DISTINCT conv_id FROM conversations))"


def _contexts(spark, sf_dir):
    i = F.col("id")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct().select(
        "id", F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("system of "), i)).alias("system"), F.when(i % 4 != 1, F.concat(F.lit("summary of "), i)).alias("text"),
        (i % 5 != 2).alias("use_map_reduce"), (i % 7 != 3).alias("hierarchical"),
    )


@R.query("c08_map_reduce", f"""WITH {_CONTEXTS}, r AS (SELECT id, 0 AS part, 0 AS turn, 'system' AS role, system AS content FROM x WHERE flag AND data AND trim(system) <> ''
  UNION ALL SELECT id, 1, turn, role, c.text FROM conversations c JOIN x ON id = conv_id WHERE flag AND data UNION ALL SELECT id, 2, 0, 'user', text FROM x WHERE flag AND data AND text IS NOT NULL)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, turn, role, content) - 1 AS place, role, content FROM r""")
def c08(spark, sf_dir):
    """The messages of a map-reduce composition's last step."""
    history = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", F.col("text").alias("content"))
    rows = agents.reduce_messages(_contexts(spark, sf_dir), history)
    return rows.select("id", F.col("place").cast("long").alias("place"), "role", "content")


@R.query("u03_strategy_selection", """SELECT doc_id, CASE WHEN length(text) > 4000 THEN 'Chunking' WHEN doc_id % 11 = 0 THEN 'MultiPassReduction' WHEN doc_id % 5 = 0 THEN 'RAG' WHEN length(text) // 4 < 300 THEN 'Simple' WHEN doc_id % 2 = 0 THEN 'MapReduce' END AS strategy,
  CASE WHEN length(text) > 4000 OR doc_id % 11 = 0 THEN true WHEN doc_id % 5 = 0 OR length(text) // 4 < 300 OR doc_id % 2 = 0 THEN false END AS iterative FROM documents""")
def u03(spark, sf_dir):
    """The strategy that composes each text's messages: iterative ones first, then by priority."""
    i, size = F.col("doc_id"), F.length("text")
    can = {"Simple": code.text_tokens(F.col("text")) < 300, "RAG": i % 5 == 0, "MapReduce": i % 2 == 0, "Chunking": size > 4000, "MultiPassReduction": i % 11 == 0}
    name, iterative = agents.chosen_strategy(can)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("strategy"), iterative.alias("iterative"))


_HOPS = """WITH RECURSIVE a AS (SELECT * FROM (VALUES ('web', 'reader'), ('code', 'coder'), ('plan', 'planner')) v(type, role)),
h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'code' WHEN 2 THEN 'plan' ELSE 'none' END AS type, 0 AS hop FROM documents
  UNION ALL SELECT doc_id, CASE type WHEN 'plan' THEN 'code' ELSE 'web' END, hop + 1 FROM h WHERE (type = 'plan') OR (type = 'code' AND doc_id % 3 = 0))"""


def _dispatched(spark, sf_dir):
    i = F.col("doc_id") % 4
    tasks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.when(i == 0, "web").when(i == 1, "code").when(i == 2, "plan").otherwise("none").alias("type"))
    able = spark.sql("select * from values (0, 'reader', 'web'), (1, 'coder', 'code'), (2, 'planner', 'plan'), (3, 'spare', 'web') as v(place, role, type)")
    target = F.when(F.col("type") == "plan", "code").when((F.col("type") == "code") & (F.col("task_id") % 3 == 0), "web")
    return agents.dispatched(tasks, able, target)


@R.query("i12_agent_dispatch", _HOPS + " SELECT doc_id AS task_id, role, hop AS hops, role IS NOT NULL AS success FROM (SELECT *, max(hop) OVER (PARTITION BY doc_id) AS last FROM h) LEFT JOIN a USING (type) WHERE hop = last")
def i12(spark, sf_dir):
    """Who ends up with each task, after how many delegations."""
    return _dispatched(spark, sf_dir)[0]


@R.query("i12_delegation_events", _HOPS + " SELECT f.doc_id AS task_id, f.hop, a.role AS from_role, t.type AS to_type FROM h f JOIN h t ON t.doc_id = f.doc_id AND t.hop = f.hop + 1 JOIN a ON a.type = f.type")
def i12_events(spark, sf_dir):
    """The delegations on the way."""
    return _dispatched(spark, sf_dir)[1]


@R.query("i05_index_states", """WITH e AS (SELECT user_id AS key, row_number() OVER (ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'indexed' ELSE 'changed' END AS kind, json_extract_string(props, '$.k') AS path FROM events),
  l AS (SELECT key, max(seq) FILTER (kind = 'started') AS s, max(seq) FILTER (kind = 'completed') AS c, max(seq) FILTER (kind = 'changed') AS f FROM e GROUP BY key),
  p AS (SELECT key, count(*) AS n FROM (SELECT e.key, path, arg_max(kind, seq) AS kind FROM e JOIN l ON l.key = e.key WHERE kind IN ('changed', 'indexed') AND seq > coalesce(greatest(s, c), 0) GROUP BY 1, 2) WHERE kind = 'changed' GROUP BY key)
  SELECT l.key, CASE WHEN s IS NULL AND c IS NULL THEN 'Initializing' WHEN c IS NULL OR s > c THEN 'Indexing' WHEN f > c THEN 'Stale' ELSE 'Ready' END AS state, coalesce(n, 0) AS pending FROM l LEFT JOIN p USING (key)""")
def i05(spark, sf_dir):
    """The state of each index after all its events."""
    kind = F.col("event_type")
    kind = F.when(kind == "signup", "started").when(kind == "purchase", "completed").when(kind == "view", "indexed").otherwise("changed")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("path"))
    return streams.index_states(rows)


_PHASE = "CASE event_type WHEN 'signup' THEN 'Decomposition' WHEN 'view' THEN 'Content Generation' WHEN 'click' THEN 'Evaluation' WHEN 'purchase' THEN 'Complete' END"


@R.query("i09_job_states", f"""WITH p AS (SELECT user_id AS job_id, epoch_us(ts) AS us, {_PHASE} AS phase, event_id % 101 AS percent FROM events WHERE event_type <> 'error'),
  c AS (SELECT user_id AS job_id, (ceil(min(epoch_us(ts)) / 2000000.0) * 2000000)::BIGINT AS seen FROM events WHERE event_type = 'error' AND user_id % 2 = 0 GROUP BY 1),
  l AS (SELECT p.job_id, max(struct_pack(us := us, percent := percent, phase := phase)) FILTER (seen IS NULL OR us < seen) AS l, max(seen) IS NOT NULL AS asked FROM p LEFT JOIN c USING (job_id) GROUP BY 1)
  SELECT job_id, CASE WHEN asked AND coalesce(l.phase, '') <> 'Complete' THEN 'Cancelled' WHEN l.phase = 'Decomposition' THEN 'Analyzing' WHEN l.phase = 'Complete' THEN 'Completed' ELSE 'Generating' END AS status,
    CASE WHEN asked AND coalesce(l.phase, '') <> 'Complete' THEN 0 ELSE l.percent END AS percent FROM l""")
def i09(spark, sf_dir):
    """Where each job ended, cancellations seen at the runner's next look."""
    e = table(spark, sf_dir, "events")
    phase = F.col("event_type")
    phase = F.when(phase == "signup", "Decomposition").when(phase == "view", "Content Generation").when(phase == "click", "Evaluation").when(phase == "purchase", "Complete")
    progress = e.filter("event_type <> 'error'").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), phase.alias("phase"), (F.col("event_id") % 101).alias("percent"))
    cancels = e.filter("event_type = 'error' and user_id % 2 = 0").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"))
    return agents.job_states(progress, cancels)


@R.query("i10_refresh_directory", on_graph("SELECT node_id, CASE WHEN file_path LIKE 'suppliers/3/%' THEN 'parsed' ELSE language END AS language FROM nodes"))
def i10(spark, sf_dir):
    """The nodes after the files of one directory were parsed again."""
    g = model.graph(spark, sf_dir)
    again = g.nodes.filter("file_path like 'suppliers/3/%'").withColumn("language", F.lit("parsed"))
    arcs = g.edges.limit(0)
    return streams.refreshed(g, "directory", "suppliers/3", again, arcs).nodes.select("node_id", "language")


_SCORES = f"SELECT doc_id, ['Judge_1', 'Judge_2', 'Judge_3'] AS j, [least(100, {_count('text', prose.WORDS)})::DOUBLE, 100.0 * contains(text, ',')::INT, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 50.0 END] AS s FROM documents"


@R.query("u05_judges", f"SELECT doc_id AS page_id, judge_id, score FROM (SELECT doc_id, unnest(j) AS judge_id, unnest(s) AS score FROM ({_SCORES})) WHERE score IS NOT NULL")
def u05(spark, sf_dir):
    """A list of judges over every page; a judge that fails gives no score."""
    text = F.col("content")
    judges = [F.least(F.lit(100), prose.word_count(text)), F.when(text.contains(","), 100.0).otherwise(0.0), F.when(F.col("page_id") % 4 != 0, 50.0)]
    return agents.judged(model.pages(spark, sf_dir), judges)


@R.query("u06_resumed_step", on_graph("SELECT type, count(*) AS n FROM nodes GROUP BY type"))
def u06(spark, sf_dir):
    """A step that ran before is read, not run again; one that fails leaves a snapshot."""
    path, failures = scratch(spark, "step"), scratch(spark, "failures")

    def step():
        return model.nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))

    def never():
        raise AssertionError("the step was run again")

    agents.snapshot(lambda: agents.resumable(step, spark, path), spark, failures, "by type")
    return agents.snapshot(lambda: agents.resumable(never, spark, path), spark, failures, "by type")


_HEAD = "'Judge the documentation against one requirement.' || chr(10) || 'Requirement: ' || 'Item ' || item_id || chr(10) || 'Description: ' || text || chr(10)"
_TAIL = """chr(10) || 'Answer with JSON alone: {"requirement_id", "score" from 0 to 1, "reasoning", "evidence"}' || chr(10)"""


@R.query("u07_prompts", f"""SELECT item_id, CASE WHEN item_id % 20 > 10 THEN {_HEAD} || 'Passages:' || chr(10) || 'first' || chr(10) || '---' || chr(10) || text || {_TAIL}
  ELSE {_HEAD} || 'Outline:' || chr(10) || 'pages: ' || item_id % 20 || {_TAIL} END AS prompt FROM benchmark""")
def u07(spark, sf_dir):
    """The judges' prompts: by outline, beyond ten pages by retrieved passages."""
    item, text, pages = F.concat(F.lit("Item "), "item_id"), F.col("text"), F.col("item_id") % 20
    outline = agents.default_prompt(item, text, F.concat(F.lit("pages: "), pages))
    passages = agents.retrieval_prompt(item, text, F.array(F.lit("first"), text))
    return table(spark, sf_dir, "benchmark").select("item_id", agents.prompt(pages, outline, passages).alias("prompt"))
