"""Column functions over source text, paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decision points counted by the regex complexity.
DECISIONS = (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bforeach\s*\(", r"\bswitch\s*\(", r"\bcase\s+", r"\bcatch\s*\(", r"\b\?\s*", r"\|\|", "&&")
#: Keywords that open a level of nesting.
NESTING = r"\b(if|while|for|foreach|switch|using|lock)\s*\("
#: Import forms counted as references out.
IMPORTS = (r"using\s+[\w.]+;", r"import\s+[\w.]+;", '#include\\s+[<"].+[>"]', r"require\s*\(", r"from\s+[\w.]+\s+import")
#: Marks of public content, whatever the case.
PUBLIC = (r"\bpublic\s+(class|interface|struct|enum)", r"\bexport\s+(class|interface|function|const)", r"__all__\s*=", r"@app\.route", "@RestController", "@Controller", "@Service", "@Component")
#: Marks of documentation.
DOCUMENTED = (r"/\*\*[\s\S]*?\*/", "///.*", r'"[\s\S]*?"', "#.*", "//.*")
#: Component type by content, first match.
CONTENT_TYPES = (
    (r"\bclass\s+\w+", "Class"), (r"\binterface\s+\w+", "Interface"), (r"\benum\s+\w+", "Enum"), (r"\bstruct\s+\w+", "Struct"),
    (r"\bfunction\s+\w+|\bdef\s+\w+", "Function"), (r"@\w+Controller|@RestController", "Controller"), (r"@\w+Service", "Service"),
)
#: Declarations found by regex in unknown languages.
GENERIC_CLASSES = (r"\bclass\s+(\w+)", r"\binterface\s+(\w+)", r"\bstruct\s+(\w+)", r"\benum\s+(\w+)")
GENERIC_FUNCTIONS = (r"\bfunction\s+(\w+)", r"\bdef\s+(\w+)", r"\bfunc\s+(\w+)", r"\bpublic\s+\w+\s+(\w+)\s*\(", r"\bprivate\s+\w+\s+(\w+)\s*\(")
#: Declarations in Java and Python.
JAVA_CLASS = r"(?:public|private|protected)?\s*(?:abstract|final|static)?\s*class\s+(\w+)"
JAVA_INTERFACE = r"(?:public|private|protected)?\s*interface\s+(\w+)"
PYTHON_CLASS, PYTHON_FUNCTION = r"(?m)^class\s+(\w+):", r"(?m)^def\s+(\w+)\s*\("
#: Language by file extension, for graphs and for components.
GRAPH_LANGUAGES = {"cs": "C#", "js": "JavaScript", "ts": "TypeScript", "py": "Python", "go": "Go", "rs": "Rust", "java": "Java", "cpp": "C++", "cc": "C++", "cxx": "C++", "c": "C", "h": "C++", "hpp": "C++"}
COMPONENT_LANGUAGES = {"cs": "C#", "java": "Java", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "cpp": "C++", "c": "C", "go": "Go", "rs": "Rust"}
#: Ignored path segments, for graphs and for components, and ignored extensions.
GRAPH_IGNORED = ("node_modules", "bin", "obj", ".git", ".vs", ".idea", "dist", "build", "coverage")
COMPONENT_IGNORED = ("bin", "obj", "node_modules", ".git", ".vs", "dist", "build", "debug")
IGNORED_EXTENSIONS = (".dll", ".exe", ".pdb", ".cache", ".tmp")
#: Infrastructure files by name, start of name and extension.
INFRASTRUCTURE = (
    ".gitignore", ".dockerignore", "dockerfile", "docker-compose.yml", ".env", ".env.example", "license", "readme.md", "contributing.md", "changelog.md",
    "package.json", "package-lock.json", "tsconfig.json", "jsconfig.json", "eslint.config.js", "appsettings.json", "nuget.config", "packages.config",
    "pom.xml", "build.gradle", "settings.gradle", "gradlew", "gradlew.bat", "requirements.txt", "setup.py", "pyproject.toml", "pipfile", "pipfile.lock",
    "makefile", "cmakelists.txt", "conanfile.txt", "vcpkg.json", "go.mod", "go.sum", "cargo.toml", "cargo.lock",
)
INFRASTRUCTURE_STARTS, INFRASTRUCTURE_EXTENSIONS = (".eslintrc", ".prettierrc"), (".sln", ".csproj")
#: Substrings counted once a line by the agents' complexity.
AGENT_MARKS = ("if", "for", "while", "case", "catch", "&&", "||")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def cyclomatic(text: Column) -> Column:
    return sum((matches(text, p) for p in DECISIONS), F.lit(1))


def nesting_depth(text: Column) -> Column:
    """The greatest running count of opening braces and keywords less closing braces, by line."""
    lines = F.split(text, "\n")
    steps = F.transform(lines, lambda x: matches(x, r"\{") + matches(x, NESTING) - matches(x, r"\}"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    fold = F.aggregate(steps, start, lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))
    return fold["most"]


def nesting_estimate(complexity: Column) -> Column:
    return F.when(complexity <= 5, 1).when(complexity <= 10, 2).when(complexity <= 20, 3).otherwise(4)


def component_tokens(lines: Column, complexity: Column) -> Column:
    return lines * F.lit(1.3) + complexity * 10


def file_tokens(lines: Column) -> Column:
    return lines * F.lit(1.3)


def text_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def context_share(lines: Column, context: int = 8192) -> tuple[Column, Column, Column]:
    """(tokens, percent of the context, requires chunking) for a number of lines."""
    tokens = F.ceil(lines * 4)
    return tokens, tokens / float(context) * 100, tokens > 0.8 * context


def imports(text: Column) -> Column:
    return sum((matches(text, p) for p in IMPORTS), F.lit(0))


def is_public(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(PUBLIC))


def is_documented(text: Column) -> Column:
    return text.rlike("|".join(DOCUMENTED))


def content_type(text: Column) -> Column:
    out = None
    for pattern, name in CONTENT_TYPES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("Component")


def symbol_type(attributes: Column, base: Column, name: Column, default: Column) -> Column:
    """Type of a declared symbol: by attribute, by base class, by end of its name."""
    def has(word: str) -> Column:
        return F.exists(attributes, lambda a: a.contains(word))

    return (
        F.when(has("Controller"), "Controller").when(has("Service"), "Service").when(has("Repository"), "Repository")
        .when(base.contains("Controller"), "Controller").when(name.endswith("Service"), "Service")
        .when(name.endswith("Repository"), "Repository").when(name.endswith("Controller"), "Controller").otherwise(default)
    )


def parsed_type(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.contains("controller"), "Controller").when(low.contains("service"), "Service").when(low.contains("repository"), "Repository")
    return out.when(F.coalesce(kind, F.lit("")) != "", kind).otherwise("Class")


def declarations(text: Column, patterns: tuple[str, ...], ignore_case: bool = True) -> Column:
    """All names the patterns' first group matches, pattern by pattern."""
    flag = "(?i)" if ignore_case else ""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(flag + p), F.lit(1)) for p in patterns]))


#: Entry points by language.
MAIN = {
    "C#": r"(?i)public\s+static\s+void\s+Main\s*\(", "Java": r"(?i)public\s+static\s+void\s+Main\s*\(",
    "Python": r"""if __name__ == ("__main__"|'__main__'):""",
    "JavaScript": r"app\.listen\s*\(|ReactDOM\.render|bootstrap\(\)", "TypeScript": r"app\.listen\s*\(|ReactDOM\.render|bootstrap\(\)",
    "C": r"int\s+main\s*\(", "C++": r"int\s+main\s*\(",
}


def is_entry_point(text: Column, language: Column) -> Column:
    out = F.lit(False)
    for name, pattern in MAIN.items():
        out = out | ((F.lower(language) == name.lower()) & text.rlike(pattern))
    return F.coalesce(out, F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language(path: Column, table: dict[str, str] = GRAPH_LANGUAGES, other: str = "Unknown") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[extension(path)], F.lit(other))


def segments(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def ignored_in_graph(path: Column) -> Column:
    return F.exists(segments(path), lambda s: F.lower(s).isin(*GRAPH_IGNORED) | s.startswith("."))


def ignored_component(path: Column) -> Column:
    parts = F.filter(segments(path), lambda s: s != "")
    return F.exists(parts, lambda s: F.lower(s).isin(*COMPONENT_IGNORED)) | F.concat(F.lit("."), extension(path)).isin(*IGNORED_EXTENSIONS)


def is_infrastructure(path: Column) -> Column:
    name = F.lower(F.element_at(segments(path), -1))
    starts = name.startswith(INFRASTRUCTURE_STARTS[0]) | name.startswith(INFRASTRUCTURE_STARTS[1])
    return name.isin(*INFRASTRUCTURE) | starts | F.concat(F.lit("."), extension(path)).isin(*INFRASTRUCTURE_EXTENSIONS)


def parent_directory(path: Column) -> Column:
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("Root")


def common_path(low: Column, high: Column) -> Column:
    """The common start of the least and greatest of some segment arrays: of all of them."""
    same = F.transform(F.arrays_zip(low.alias("a"), high.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
    stop = F.array_position(same, False).cast("int")
    return F.array_join(F.slice(low, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(low))), "/")


def agent_metrics(text: Column) -> tuple[Column, Column, Column]:
    """(tokens, marks, nesting) as the agents count them: marks at most once a line each."""
    lines = F.filter(F.split(text, r"[\r\n]"), lambda x: F.trim(x) != "")
    marks = F.aggregate(lines, F.lit(0), lambda n, x: n + sum((F.when(x.contains(m), 1).otherwise(0) for m in AGENT_MARKS), F.lit(0)))
    nested = F.transform(lines, lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4).cast("int"))
    return F.floor(F.length(text) / 4), marks, F.coalesce(F.array_max(nested), F.lit(0))


def agent_delegates(tokens: Column, complexity: Column, delegated: Column) -> Column:
    return F.when(delegated, "none").when(tokens > 2000, "tokens").when(complexity > 10, "complexity").otherwise("none")


#: Per language, the anchored function and class names, inheritance, access and imports.
FUNCTION_NAMES = {
    "python": r"^def\s+(\w+)", "javascript": r"^(?:function\s+(\w+)|const\s+(\w+)\s*=\s*\(|(\w+)\s*:\s*\()",
    "typescript": r"(?:function\s+(\w+)|(?:static\s+)?(\w+)\s*\([^)]*\)\s*\{|const\s+(\w+)\s*=\s*\([^)]*\)\s*=>)",
    "java": r"^(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\(", "c": r"^(?:\w+\s+)?(\w+)\s*\(",
}
CLASS_NAMES = {"python": r"^class\s+(\w+)", "javascript": r"^class\s+(\w+)", "java": r"^(?:public|private|protected)?\s*class\s+(\w+)"}
INHERITANCE = {"python": r"class\s+\w+\([^)]+\)", "javascript": r"class\s+\w+\s+extends\s+\w+", "csharp": r"class\s+\w+\s*:\s*[^{]+"}
ACCESS = {"python": r"\b\w+\.\w+", "c": r"\b\w+\->\w+"}
IMPORT_LINES = {"python": r"(?m)^(?:import|from)\s+", "javascript": r"(?m)^import\s+", "c": r"(?m)^#include\s+", "csharp": r"(?m)^using\s+"}
IMPORTED = {"python": r"(?:import|from)\s+([^\s;]+)", "javascript": r"""import.*from\s+['"]([^'"]+)['"]""", "java": r"import\s+([^;]+);", "c": r'#include\s+[<"]([^>"]+)[>"]', "csharp": r"using\s+([^;]+);"}
ENTRY_LINES = {
    "python": (("main_function", r"""if\s+__name__\s*==\s*['"]__main__['"]"""), ("main", r"def\s+main\s*\("), ("flask_route", r"@app\.route"), ("django_view", r"def\s+\w+.*request")),
    "javascript": (("main_function", r"function\s+main\s*\("), ("express_route", r"app\.(get|post|put|delete)"), ("event_listener", "addEventListener")),
    "typescript": (("main_function", r"function\s+main\s*\("), ("nest_controller", "@Controller"), ("express_route", r"app\.(get|post|put|delete)")),
    "java": (("main_method", r"public\s+static\s+void\s+main\s*\("), ("servlet", r"extends\s+HttpServlet"), ("spring_controller", "@Controller")),
    "c": (("main_function", r"int\s+main\s*\("),),
    "cpp": (("main_function", r"int\s+main\s*\("), ("constructor", r"class\s+\w+")),
    "csharp": (("main_method", r"static\s+void\s+Main\s*\("), ("webapi_controller", r"\[ApiController\]")),
}
#: A qualified name.
QUALIFIED = r"\b(\w+)\.\w+"


#: Comments and strings of brace languages.
BLANKS = r"""/\*[\s\S]*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
#: Decision points of the walker, of a type's body and of a script; methods and properties.
WALKER = r"\b(?:if|for|foreach|while|case|catch)\b"
TYPE_POINTS, SWITCH, TERNARY = r"\b(?:if|while|for|foreach)\b", r"\bswitch\b", r"[^?]\?[^?.\[:]"
SCRIPT_POINTS, LOGICAL, BIT_AND = r"\b(?:if|for|while|do|case|catch|switch)\b", r"&&|\|\|", r"[^&]&[^&]"
METHOD = r"\b(\w+)\s*(?:<[^>()]*>)?\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:where[^{]{0,500}|=>|throws[^{]{0,500})?\s*\{"
NO_METHOD = ("if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "new", "else")
PROPERTY = r"\b\w+\s*\{\s*(?:public|private|protected|internal)?\s*(?:get|set|init)\b"
DECORATOR = r"(?m)^[ \t]*@(\w+)"


def blanked(text: Column) -> Column:
    """The text with comments and strings as spaces."""
    return F.regexp_replace(text, BLANKS, " ")


def walker_complexity(text: Column) -> Column:
    return matches(blanked(text), WALKER) + 1


def type_complexity(text: Column) -> Column:
    """Decision points, operators, methods and properties; switches count twice."""
    code = blanked(text)
    methods = F.filter(F.regexp_extract_all(code, F.lit(METHOD), F.lit(1)), lambda x: ~x.isin(*NO_METHOD))
    return F.lit(1) + matches(code, TYPE_POINTS) + matches(code, SWITCH) * 2 + matches(code, LOGICAL) + matches(code, TERNARY) + F.size(methods) + matches(code, PROPERTY)


def script_complexity(text: Column) -> Column:
    """Decision nodes of a script; logical operators count once more as binary ones."""
    code = blanked(text)
    return F.lit(1) + matches(code, SCRIPT_POINTS) + matches(code, TERNARY) + matches(code, LOGICAL) * 2 + matches(code, BIT_AND)


def line_names(text: Column, pattern: str, groups: int = 1) -> Column:
    """Per line the first match's first non-empty group; lines without one are left out."""
    def name(x: Column) -> Column:
        found = [F.regexp_extract(x, pattern, g) for g in range(1, groups + 1)]
        return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])

    return F.filter(F.transform(F.split(text, "\n"), name), lambda x: x.isNotNull())


def entry_lines(text: Column, lang: str) -> Column:
    """array of (type, line, signature) of the lines that match an entry pattern."""
    lines = F.split(text, "\n")

    def matching(name: str, pattern: str) -> Column:
        def row(x: Column, i: Column) -> Column:
            return F.when(x.rlike(pattern), F.struct(F.lit(name).alias("type"), (i + 1).alias("line"), F.substring(F.trim(x), 1, 100).alias("signature")))

        return F.transform(lines, row)

    return F.filter(F.flatten(F.array(*[matching(n, p) for n, p in ENTRY_LINES[lang]])), lambda x: x.isNotNull())


def qualified_names(text: Column, most: int = 5) -> Column:
    names = F.regexp_extract_all(text, F.lit(QUALIFIED), F.lit(1))
    return F.slice(F.filter(names, lambda x: ~x.isin("this", "console")), 1, most)
