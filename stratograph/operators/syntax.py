"""Types, members, calls and base lists of source files, as joins and windows over their tokens.

A file becomes its braces, brackets and semicolons, one row each, with the run of tokens before
it; running sums over them give the levels, and with these the statements: what stands between
``;``, ``{`` and ``}``.  Over the
statements, running sums again tell which type and which member each lies in, and differences
of running sums at a block's two ends what it holds, so nothing is joined with what encloses it.
Python's indentation is turned into braces first.  A file's rows are sorted in one task; files
are as many tasks as there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.code import symbol_type
from ..sources.model import Graph, build
from ..sources.tables import cut

_STRINGS = r'''"""[\s\S]*?"""|(?:\$@|@\$|@)"[^"]*(?:""[^"]*)*"|\$?"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\[\s\S][^`\\]*)*`'''
_REST = r"[\p{L}_$][\p{L}\p{N}_$]*|[0-9][0-9A-Za-z_.]*|\n|&&|\|\||=>|->|::|\?\?=?|\?\.|[+\-*/%&|^!<>=]=|\S"
#: Tokens of brace languages, of those among them with directives, and of Python.
BRACES = rf"/\*[\s\S]*?\*/|//[^\n]*|{_STRINGS}|{_REST}"
DIRECTIVES = rf"#[^\n]*|{BRACES}"
INDENTED = r'''#[^\n]*|(?i:[rbuf]{0,2})(?:"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')|\\\r?\n|\n[ \t]*|''' + _REST.replace(r"\n|", "", 1)
COMMENT, STRING = r"^(?:/\*[\s\S]*\*/|//[\s\S]*|#[\s\S]*)$", r'''^[A-Za-z$@]{0,2}["'`]'''

#: In statements, tokens stand one blank apart, strings are ``""`` and comments are gone.
TYPE = r"(?:^|^[^=]* )(class|interface|struct|enum|record)(?: (?:class|struct))? ([\p{L}_$][\p{L}\p{N}_$]*)((?: (?:[<:(]|(?:extends|implements|final|permits|where) ).*)?)$"
ATTRIBUTES = r"^(?:\[ [^\]]* \] |@ [\p{L}\p{N}_$]+(?: \. [\p{L}\p{N}_$]+)*(?: \( [^()]*(?:\( [^()]*\) ?[^()]*)*\))? )+"
NAMED = r"^((?:[^()=]* )?)([\p{L}_$][\p{L}\p{N}_$]*)(?: < [^()=]* >)? \("
ASSIGNED = r"([\p{L}_$][\p{L}\p{N}_$]*) = (?:async )?(?:function .*\)|\( .*\) =>|\( \) =>|[\p{L}_$][\p{L}\p{N}_$]* =>)$"
ACCESSOR = r"^(?:(?:public|private|protected|internal) )?(?:get|set|init)(?: |$)"
CALL = r"(?:[\p{L}_$][\p{L}\p{N}_$]* (?:\.|\?\.|->|::) )?[\p{L}_$][\p{L}\p{N}_$]*(?: < [\p{L}\p{N}_$ ,.]* >)? \("
#: Words before a bracket that call or declare nothing.
CONTROL = (
    "if", "for", "foreach", "while", "do", "switch", "catch", "using", "lock", "fixed", "return", "new", "else", "elif", "except", "with", "when", "await", "throw", "yield",
    "sizeof", "typeof", "nameof", "default", "not", "and", "or", "in", "is", "as", "assert", "del", "lambda", "function", "synchronized", "case", "super", "this", "base", "class", "def",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def braced(tokens: list[str]) -> list[str]:
    """Python's tokens with ``{`` and ``}`` around blocks and ``;`` after other lines."""
    out: list[str] = []
    feeds: list[str] = []  # kept back, so that a block ends on its last line
    stack, line, last, depth, indent, block = [0], "", "", 0, 0, False
    for token in [*tokens, "\n"]:
        if token[0] == "\n" and not depth:
            if line and last == ":":
                out[-1] = "{"
                block = True
            elif line not in ("", "@"):  # a decorator belongs to what follows
                out.append(";")
            line, indent = "", len(token) - 1
        if token[0] in "\n\\":
            feeds.append("\n")
        elif token[0] != "#":
            if not line and not depth:
                if block and indent > stack[-1]:
                    stack.append(indent)
                elif block:
                    out.append("}")
                block = False
                while indent < stack[-1]:
                    stack.pop()
                    out.append("}")
            depth = max(0, depth + (token in ("(", "[", "{")) - (token in (")", "]", "}")))
            out += [*feeds, {"{": "(", "}": ")"}.get(token, token)]
            feeds, line, last = [], line or token, "" if depth else token
    return out + ["}"] * (block + len(stack) - 1)


def tokens(files: DataFrame) -> DataFrame:
    """(path, language, tokens) of files (path, language, content); null contents have none."""
    rows = files.select("path", "language", F.coalesce("content", F.lit("")).alias("t"))
    plain = rows.filter("language <> 'Python'")
    found = F.when(F.col("language").isin("C", "C++", "C#"), F.regexp_extract_all("t", F.lit(DIRECTIVES), F.lit(0))).otherwise(F.regexp_extract_all("t", F.lit(BRACES), F.lit(0)))
    indented = rows.filter("language = 'Python'").select("path", "language", F.regexp_extract_all("t", F.lit(INDENTED), F.lit(0)).alias("tokens"))

    def brace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([braced(t) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], names=batch.schema.names)

    indented = indented.mapInArrow(brace, indented.schema)
    return plain.select("path", "language", found.alias("tokens")).unionByName(indented)


def _told(token: Column) -> Column:
    """Whether a token is neither blank nor a comment (COMMENT)."""
    comment = token.startswith("//") | token.startswith("#") | (token.startswith("/*") & token.endswith("*/") & (F.length(token) >= 4))
    return ~F.trim(token).isin("", "\n") & ~comment


def _runs(files: DataFrame) -> DataFrame:
    """(path, language, i, tok, canon, raw, any, first, last, feeds): the runs of tokens up to each brace, bracket or
    semicolon tok, null at the end of a file; any: whether tokens are in the run, canon and raw: they, one blank
    apart; first, last: line feeds of the run before the first and the last of them; feeds: all."""
    at = F.filter(F.transform("tokens", lambda x, i: F.when(x.isin("{", "}", "(", ")", ";"), i + 1)), lambda i: i.isNotNull())
    rows = tokens(files).select("path", "language", "tokens", F.concat(F.array(F.lit(0)), at, F.array(F.size("tokens") + 1)).alias("at"))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("at") - 2), lambda k: F.struct(F.slice("tokens", F.get("at", k) + 1, F.get("at", k + 1) - F.get("at", k) - 1).alias("run"), F.get("tokens", F.get("at", k + 1) - 1).alias("tok"))
    )
    rows = rows.select("path", "language", F.posexplode(runs).alias("i", "r")).select("path", "language", "i", "r.tok", "r.run")
    rows = rows.withColumn("told", F.transform("run", _told)).withColumn("held", F.filter("run", _told)).filter("tok is not null or size(held) > 0")
    canon = F.transform("held", lambda x: F.when(x.rlike(STRING), '""').otherwise(x))
    first = F.array_position("told", True).cast("int")
    last = F.size("told") + 1 - F.array_position(F.reverse("told"), True).cast("int")
    feeds = lambda run: F.length(run) - F.length(F.replace(run, F.lit("\n"), F.lit("")))
    upto = lambda n: feeds(F.array_join(F.slice("run", 1, F.greatest(n - 1, F.lit(0))), ""))
    some = F.size("held") > 0
    return rows.select(
        "path", "language", "i", "tok", some.alias("any"), F.array_join(canon, " ").alias("canon"), F.array_join("held", " ").alias("raw"),
        F.when(some, upto(first)).alias("first"), F.when(some, upto(last)).alias("last"), feeds(F.array_join("run", "")).alias("feeds"),
    )


def statements(files: DataFrame) -> DataFrame:
    """(path, language, seq, head, raw, ends, line, last_line): what stands between boundaries.

    ends is the boundary behind it, or empty at the end of a file; a ``;`` in brackets is none.
    Only braces, brackets and semicolons are rows, with the run of tokens before them."""
    of_file = Window.partitionBy("path").orderBy("i")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    rows = _runs(files).withColumn("line", F.lit(1) + F.coalesce(F.sum("feeds").over(before), F.lit(0)))
    step = lambda a, b: F.sum(F.coalesce((F.col("tok") == a).cast("int") - (F.col("tok") == b).cast("int"), F.lit(0))).over(of_file)
    rows = rows.withColumn("level", step("{", "}")).withColumn("depth", step("(", ")"))
    inside = Window.partitionBy("path", "level").orderBy("i")
    rows = rows.withColumn("outer", F.coalesce(F.last(F.when(F.col("tok") == "{", F.col("depth")), ignorenulls=True).over(inside), F.lit(0)))
    boundary = F.coalesce(F.col("tok").isin("{", "}") | ((F.col("tok") == ";") & (F.col("depth") <= F.col("outer"))), F.lit(False))
    rows = rows.withColumn("boundary", boundary)
    rows = rows.withColumn("seq", F.coalesce(F.sum(F.col("boundary").cast("int")).over(before), F.lit(0)))
    more = F.when(~F.col("boundary"), F.col("tok"))
    part = lambda run: F.concat_ws(" ", F.when(F.col("any"), F.col(run)), more)
    held = F.when(F.col("any") | more.isNotNull(), F.struct("i", part("canon").alias("canon"), part("raw").alias("raw")))
    own = F.when(F.col("tok").isNotNull(), F.col("line") + F.col("feeds"))  # of the token behind the run
    out = rows.groupBy("path", "language", "seq").agg(
        F.sort_array(F.collect_list(held)).alias("held"), F.coalesce(F.max(F.when(F.col("boundary"), F.col("tok"))), F.lit("")).alias("ends"),
        F.min(F.coalesce(F.col("line") + F.col("first"), own)).alias("line"), F.max(F.coalesce(own, F.col("line") + F.col("last"))).alias("last_line"),
    )
    head, raw = F.array_join(F.transform("held", lambda x: x["canon"]), " "), F.array_join(F.transform("held", lambda x: x["raw"]), " ")
    return out.select("path", "language", "seq", head.alias("head"), raw.alias("raw"), "ends", "line", "last_line")


def blocks(rows: DataFrame) -> DataFrame:
    """``statements`` with what each declares (kind, name) and lies in (type_name, member), and
    for those with a block its end and what it holds.  scope: the type that a member belongs to.

    kind: a type's word (class ...), Method, Constructor, Property, Function, or null."""
    of_file = Window.partitionBy("path").orderBy("seq")
    step = F.when(F.col("ends") == "{", 1).when(F.col("ends") == "}", -1).otherwise(0)
    rows = rows.withColumn("level", F.sum(step).over(of_file))
    rows = rows.withColumn("pair", F.col("level") + (F.col("ends") == "}").cast("int"))
    paired = Window.partitionBy("path", "pair")
    bare = F.regexp_replace("head", ATTRIBUTES, "")
    rows = rows.withColumn("bare", bare).withColumn("next", F.lead("head").over(of_file)).withColumn("open", F.col("ends") == "{")
    whole = F.col("open") | ((F.col("ends") == ";") & F.col("bare").rlike(r"(?:^| )record .*\)(?: : .*)?$"))
    rows = rows.withColumn("type_kind", F.when(whole & F.col("bare").rlike(TYPE), F.regexp_extract("bare", TYPE, 1)))
    rows = rows.withColumn("type_own", F.when(F.col("type_kind").isNotNull(), F.regexp_extract("bare", TYPE, 2)))

    def context(rows: DataFrame, flag: str, value: Column, name: str) -> DataFrame:
        """name: the value of the innermost open block that has ``flag``, before each statement."""
        opens = F.last(F.when(F.col("open"), F.col(flag)), ignorenulls=True).over(paired.orderBy("seq"))
        change = F.when(F.col("open") & F.col(flag), 1).when((F.col("ends") == "}") & F.coalesce(opens, F.lit(False)), -1).otherwise(0)
        rows = rows.withColumn("_change", change).withColumn("_in", F.sum("_change").over(of_file))
        after = F.last(F.when(F.col("open") & F.col(flag), value), ignorenulls=True).over(Window.partitionBy("path", "_in").orderBy("seq"))
        rows = rows.withColumn("_after", F.when(F.col("_in") > 0, after))
        return rows.withColumn(name, F.lag("_after").over(of_file)).drop("_change", "_in", "_after")

    rows = context(rows.withColumn("is_type", F.col("type_kind").isNotNull()), "is_type", F.struct(F.col("type_own").alias("name"), F.col("type_kind").alias("kind"), F.col("level").alias("level")), "type")
    direct = F.col("type").isNotNull() & (F.col("type.level") == F.col("level") - F.col("open").cast("int") + (F.col("ends") == "}").cast("int"))  # nothing else is open in between
    python, script = F.col("language") == "Python", F.col("language").isin("JavaScript", "TypeScript")
    name, prefix = F.regexp_extract("bare", NAMED, 2), F.regexp_extract("bare", NAMED, 1)
    balanced = _count(F.col("bare"), r"\(") == _count(F.col("bare"), r"\)")
    declares = (name != "") & ~name.isin(*CONTROL) & ~prefix.rlike(r"(?:^| )(?:new|return|throw|await|yield|else|case|if|for|while) |[.?+\-/!]") & balanced & (F.col("type_kind").isNull())
    given = F.regexp_extract("bare", ASSIGNED, 1)
    words = prefix.rlike(r"(?:[\p{L}\p{N}_$>\]*&?]| ::) $")
    member = (
        F.when(F.col("type_kind").isNotNull(), F.lit(None))
        .when(python, F.when(F.col("open") & prefix.rlike(r"(?:^|\s)def $"), name))
        .when(F.col("open") & script & (given != ""), given)
        .when(F.col("open") & prefix.rlike(r"(?:^| )function (?:\* )?$") & declares, name)
        .when(F.col("open") & direct & declares, name)
        .when(F.col("open") & (F.col("level") == 1) & ~script & declares & words, name)
        .when(F.col("open") & ~script & declares & words & F.col("type").isNull(), name)
        .when((F.col("ends") == ";") & direct & ~python & (name != "") & ~name.isin(*CONTROL) & ~prefix.rlike(r"(?:^| )(?:new|return|throw) |[.?]") & (words | script | F.col("bare").rlike(r"\) =>")) & (balanced | F.col("bare").rlike(r"\) =>")), name)
    )
    rows = rows.withColumn("direct", direct).withColumn("member_own", member)
    field = F.when(F.col("open") & direct & ~F.col("bare").rlike(r"[()=]") & F.col("next").rlike(ACCESSOR), F.regexp_extract("bare", r"([\p{L}_$][\p{L}\p{N}_$]*)$", 1))
    field = field.when((F.col("ends") == ";") & direct & (F.col("language") == "C#") & F.col("bare").rlike(r"^[^()=]* =>"), F.regexp_extract("bare", r"([\p{L}_$][\p{L}\p{N}_$]*) =>", 1))
    rows = rows.withColumn("field_own", F.when(F.col("member_own").isNull() & F.col("type_kind").isNull(), F.nullif(field, F.lit(""))))
    scope = F.when(F.col("direct"), F.col("type.name")).otherwise(F.nullif(F.regexp_extract(prefix, r"([\p{L}_$][\p{L}\p{N}_$]*) :: $", 1), F.lit("")))  # of a member, in its type or outside of it
    rows = rows.withColumn("scope", scope)
    inner = F.col("member_own").isNotNull() & F.col("open")
    rows = context(rows.withColumn("is_member", inner), "is_member", F.struct(F.col("member_own").alias("name"), F.col("scope").alias("type")), "within")
    nested = F.col("within").isNotNull() & ~(python | script) & F.col("member_own").isNotNull() & ~F.col("direct")
    built = F.col("member_own").isin("constructor", "__init__") | (F.col("member_own") == F.col("type.name"))
    kind = F.coalesce("type_kind", F.when(F.col("member_own").isNotNull() & ~nested, F.when(F.col("scope").isNull(), "Function").when(built, "Constructor").otherwise("Method")), F.when(F.col("field_own").isNotNull(), "Property"))
    rows = rows.withColumn("kind", kind).withColumn("name", F.coalesce("type_own", F.when(~nested, F.col("member_own")), "field_own"))

    code = F.col("head")
    words = lambda some: _count(code, rf"(?<![^ ])(?:{some})(?![^ ])")
    ifs, loops = words("if|elif"), words("for|foreach|while")
    logical = words(r"&&|\|\|") + F.when(python, words("and|or")).otherwise(0)
    conditional = F.when(python, 0).otherwise(F.least(words(r"\?"), words(":")))
    counts = {
        "points": ifs + loops + 2 * words("switch") + logical + conditional,
        "walk": ifs + loops + words("case|catch|except"),
        "methods": (F.col("kind") == "Method").cast("int"),
        "fields": (F.col("kind") == "Property").cast("int"),
    }
    rows = rows.withColumn("sums", F.struct(*[F.coalesce(F.sum(v).over(of_file), F.lit(0)).alias(k) for k, v in counts.items()]))
    end = F.struct("last_line", "sums", "seq")
    rest = of_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closing = F.last(F.when(F.col("ends") == "}", end), ignorenulls=True).over(paired.orderBy(F.desc("seq")))
    rows = rows.withColumn("close", F.coalesce(F.when(F.col("open"), closing), F.when(F.col("open"), F.last(end).over(rest))))
    for k in counts:
        rows = rows.withColumn(k, F.when(F.col("open"), F.col(f"close.sums.{k}") - F.col(f"sums.{k}")).otherwise(0))
    rows = rows.withColumn("end_line", F.coalesce("close.last_line", "last_line"))
    return rows.select("path", "language", "seq", "head", "raw", "bare", "ends", "line", "end_line", "kind", "name", F.col("type.name").alias("type_name"), F.col("type.kind").alias("type_kind"), "direct", "scope", "within", "points", "walk", "methods", "fields")


def _id(path: Column, owner: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), F.when(owner.isNotNull(), F.concat(owner, F.lit("."))).otherwise(""), name)


def _bases(head: Column, language: Column) -> Column:
    """The names in a type's list of bases; arguments of generics, parameters and constraints are left out."""
    rest = F.regexp_extract(head, TYPE, 3)
    for _ in range(3):
        rest = F.regexp_replace(rest, r" < [^<>]* >", "")
    rest = F.regexp_replace(rest, r" where .*$", "")
    rest = F.when(language == "Python", F.regexp_replace(rest, r"^ \(|\)$", "")).otherwise(F.regexp_replace(rest, r" \( [^()]*\)| \( \)", ""))
    names = F.transform(F.split(rest, r",|(?: |^)(?:extends|implements|permits|:)(?= |$)"), lambda x: F.replace(F.regexp_replace(F.trim(x), r"^(?:(?:public|private|protected|virtual) )+", ""), F.lit(" "), F.lit("")))
    return F.filter(names, lambda x: x.rlike(r"^[\p{L}_$][\p{L}\p{N}_$.:]*$"))


def elements(rows: DataFrame) -> DataFrame:
    """(id, path, language, kind, type, name, owner, line, end_line, complexity, walk, bases, attributes) of ``blocks``.

    complexity: one, decision points, logical and conditional operators, switches twice, and a
    type's methods and properties; walk: one, branches, loops, cases and catches.  type: what
    attributes and names say of a type, else its kind."""
    own = rows.filter("kind is not null")
    kind = F.initcap("kind")
    is_type = F.col("kind").isin("class", "interface", "struct", "enum", "record")
    owner = F.when(~is_type, F.col("scope"))
    attributes = F.filter(F.concat(F.regexp_extract_all("head", F.lit(r"@ ([\p{L}\p{N}_$]+(?: \. [\p{L}\p{N}_$]+)*)"), F.lit(1)), F.regexp_extract_all("head", F.lit(r"(?:^|\] )\[ ([\p{L}\p{N}_$]+)"), F.lit(1))), lambda x: x != "interface")
    bases = F.when(is_type, _bases(F.col("bare"), F.col("language"))).otherwise(F.array().cast("array<string>"))
    names = F.transform(attributes, lambda x: F.replace(x, F.lit(" "), F.lit("")))
    found = own.select(
        _id(F.col("path"), owner, F.col("name")).alias("id"), "path", "language", kind.alias("kind"), "name", owner.alias("owner"), "line", "end_line",
        (F.lit(1) + F.col("points") + F.col("methods") + F.col("fields")).cast("int").alias("complexity"), (F.col("walk") + 1).cast("int").alias("walk"), bases.alias("bases"), names.alias("attributes"),
    )
    kinds = F.when(is_type_name(F.col("kind")), symbol_type(F.col("attributes"), F.coalesce(F.get("bases", F.lit(0)), F.lit("")), F.col("name"), F.col("kind"))).otherwise(F.col("kind"))
    return found.select("id", "path", "language", "kind", kinds.alias("type"), "name", "owner", "line", "end_line", "complexity", "walk", "bases", "attributes")


def is_type_name(kind: Column) -> Column:
    return kind.isin("Class", "Interface", "Struct", "Enum", "Record")


def enum_members(rows: DataFrame) -> DataFrame:
    """(id, path, owner, name, line) of the members of enums."""
    lists = rows.filter("type_kind = 'enum' and direct and kind is null and head <> '' and ends in ('}', ';')")
    names = F.explode(F.split("bare", " ?, ?")).alias("part")
    found = lists.select("path", F.col("type_name").alias("owner"), "line", names)
    found = found.select("path", "owner", "line", F.regexp_extract(F.regexp_replace("part", ATTRIBUTES, ""), r"^([\p{L}_$][\p{L}\p{N}_$]*)", 1).alias("name")).filter("name <> ''")
    return found.select(_id(F.col("path"), F.col("owner"), F.col("name")).alias("id"), "path", "owner", "name", "line")


def imports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name): what files import, use, include or require; each once."""
    patterns = {
        "C#": r"^(?:global )?using (?:static )?(?:[\p{L}\p{N}_$]+ = )?([\p{L}\p{N}_$]+(?: \. [\p{L}\p{N}_$]+)*)$",
        "Java": r"^import (?:static )?([\p{L}\p{N}_$]+(?: \. [\p{L}\p{N}_$*]+)*)$",
        "Python": r"^(?:import|from) (\.?(?: ?\. ?)*[\p{L}\p{N}_$]*(?: \. [\p{L}\p{N}_$]+)*)",
    }
    out = None
    for language, pattern in patterns.items():
        name = F.replace(F.regexp_extract("head", pattern, 1), F.lit(" "), F.lit(""))
        found = rows.filter((F.col("language") == language) & (F.col("ends") == ";")).select("path", name.alias("name"))
        out = found if out is None else out.unionByName(found)
    source = r"""(?:^| )(?:import|from|require \() ["'`]([^"'`]+)["'`]"""
    scripts = rows.filter(F.col("language").isin("JavaScript", "TypeScript")).select("path", F.explode(F.regexp_extract_all("raw", F.lit(source), F.lit(1))).alias("name"))
    include = r"""(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]"""
    headers = files.filter(F.col("language").isin("C", "C++")).select("path", F.explode(F.regexp_extract_all("content", F.lit(include), F.lit(1))).alias("name"))
    return out.unionByName(scripts).unionByName(headers).filter("name <> ''").distinct()


def calls(rows: DataFrame) -> DataFrame:
    """(path, owner_type, owner, receiver, name, created): calls, and objects created, in members,
    or in none (owner null); one row each time."""
    body = F.when(F.col("kind").isNull() | F.col("kind").isin("Property"), F.col("bare")).when(F.col("ends") == ";", F.regexp_extract("bare", r"=> (.*)$", 1))
    own = F.when(F.col("kind").isin("Method", "Function", "Constructor", "Property"), F.col("name")).otherwise(F.col("within.name"))
    owner_type = F.when(F.col("kind").isin("Method", "Constructor", "Property"), F.col("scope")).otherwise(F.coalesce("within.type", F.when(F.col("within").isNull(), F.col("type_name"))))
    text = F.coalesce(body, F.lit(""))
    found = rows.select("path", owner_type.alias("owner_type"), own.alias("owner"), F.explode(F.regexp_extract_all(text, F.lit(r"(?<![^ ])(?:new )?" + CALL), F.lit(0))).alias("call"))
    name = F.regexp_extract("call", r"([\p{L}_$][\p{L}\p{N}_$]*)(?: < .* >)? \($", 1)
    receiver = F.nullif(F.regexp_extract("call", r"([\p{L}_$][\p{L}\p{N}_$]*) (?:\.|\?\.|->|::) ", 1), F.lit(""))
    found = found.select("path", "owner_type", "owner", receiver.alias("receiver"), name.alias("name"), F.col("call").startswith("new ").alias("created"))
    return found.filter(~F.col("name").isin(*[c for c in CONTROL if c not in ("super", "this", "base")]) & ~(F.col("name").isin("super", "this", "base") & F.col("receiver").isNull()))


def call_arcs(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, n) of ``calls`` to known ``elements``: of the type that the receiver names, else of
    the caller's own type, else of the same file, else the first of that name anywhere, which
    needs a receiver that can be a variable or none.  Each step is an equality join with one row a key."""
    def first(keys: list[str], rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min("id").alias(name))

    members = nodes.filter(~is_type_name(F.col("kind")) & F.col("kind").isin("Method", "Function", "Constructor")).select("id", "path", F.col("owner").alias("type_of"), "name")
    types = nodes.filter(is_type_name(F.col("kind"))).select("id", "path", F.lit(None).cast("string").alias("type_of"), "name")
    both = members.filter("type_of is null or name not in ('constructor', '__init__')").unionByName(types)
    rows = found.groupBy("path", "owner_type", "owner", "receiver", "name").agg(F.count("*").alias("n"))
    own = F.coalesce(F.col("receiver").isin("this", "self", "base", "super", "cls"), F.lit(True))
    rows = rows.withColumn("own_type", F.when(own, F.col("owner_type"))).withColumn("other", F.when(~own, F.col("receiver")))
    rows = rows.join(first(["type_of", "name"], members.filter("type_of is not null"), "d1").withColumnRenamed("type_of", "other"), ["other", "name"], "left")
    rows = rows.join(first(["path", "type_of", "name"], members.filter("type_of is not null"), "d2").withColumnRenamed("type_of", "own_type"), ["path", "own_type", "name"], "left")
    rows = rows.join(first(["path", "name"], both, "d3"), ["path", "name"], "left").join(first(["name"], both, "d4"), "name", "left")
    variable = own | F.col("receiver").rlike(r"^[\p{Ll}_$]")
    dst = F.coalesce("d1", "d2", F.when(variable, F.coalesce("d3", "d4")))
    src = F.when(F.col("owner").isNull() & F.col("owner_type").isNull(), F.col("path")).when(F.col("owner").isNull(), _id(F.col("path"), F.lit(None).cast("string"), F.col("owner_type"))).otherwise(_id(F.col("path"), F.col("owner_type"), F.col("owner")))
    return rows.select(src.alias("src"), dst.alias("dst"), "n").filter("dst is not null and src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def syntax_graph(files: DataFrame) -> Graph:
    """The graph of files (path, language, content): files, types and members, what contains what,
    bases, imports and calls.

    Bases and imports resolve to the first element of that name, imports to the first file of
    that stem too; what resolves to nothing is dropped.  Calls of one pair are one arc."""
    rows = cut(blocks(statements(files)), "blocks")
    found = elements(rows)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    whole = files.select(F.col("path").alias("node_id"), F.lit("File").alias("type"), F.element_at(F.split("path", r"[/\\]"), -1).alias("name"), "language", F.col("path").alias("file_path"), F.coalesce(lines, F.lit(1)).alias("line_count"), F.lit(1).alias("complexity"))
    nodes = found.select(F.col("id").alias("node_id"), "type", "name", "language", F.col("path").alias("file_path"), (F.col("end_line") - F.col("line") + 1).cast("int").alias("line_count"), "complexity")
    members = enum_members(rows)
    language = files.select("path", "language")
    enums = members.join(language, "path").select(F.col("id").alias("node_id"), F.lit("EnumMember").alias("type"), "name", "language", F.col("path").alias("file_path"), F.lit(1).alias("line_count"), F.lit(1).alias("complexity"))
    nodes = whole.unionByName(nodes).unionByName(enums)
    container = F.when(F.col("owner").isNull(), F.col("path")).otherwise(_id(F.col("path"), F.lit(None).cast("string"), F.col("owner")))
    contains = found.select(container.alias("src"), F.col("id").alias("dst")).unionByName(members.select(container.alias("src"), F.col("id").alias("dst"))).distinct().withColumn("type", F.lit("Contains"))
    types = found.filter(is_type_name(F.col("kind")))
    named = types.groupBy("name").agg(F.min("id").alias("dst"))
    bases = types.select(F.col("id").alias("src"), "kind", F.explode("bases").alias("base"))
    bases = bases.withColumn("name", F.element_at(F.split("base", r"[.:]+"), -1)).join(named, "name")
    kind = F.when((F.col("kind") == "Interface") | F.col("name").rlike("^I[A-Z]"), "Implementation").otherwise("Inheritance")
    bases = bases.select("src", "dst", kind.alias("type")).filter("src <> dst")
    stem = F.regexp_replace(F.element_at(F.split("path", r"[/\\]"), -1), r"\.[^.]+$", "")
    stems = files.select(stem.alias("name"), F.col("path").alias("id")).unionByName(types.select("name", "id")).groupBy("name").agg(F.min("id").alias("dst"))
    used = imports(rows, files).select(F.col("path").alias("src"), F.element_at(F.split(F.regexp_replace("name", r"\.(?:js|ts|h|hpp)$", ""), r"[./\\:]+"), -1).alias("name"))
    used = used.join(stems, "name").filter("src <> dst").select("src", "dst", F.lit("Dependency").alias("type"))
    called = call_arcs(calls(rows), found).select("src", "dst", F.lit("Call").alias("type"))
    kinds = [a.withColumn("seq", F.lit(i)) for i, a in enumerate((contains, bases, used, called))]  # of two arcs between the same nodes the first kind counts
    arcs = reduce(DataFrame.unionByName, kinds)
    return build(nodes, arcs.select("seq", "src", "dst", "type", F.lit(1.0).alias("strength")))
