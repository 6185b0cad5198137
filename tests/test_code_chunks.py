"""Chunks of code along the elements of files, and their index after changes."""

from pyspark.sql import functions as F
from test_syntax import FILES

from stratograph.functions.code import GRAPH_LANGUAGES, language
from stratograph.operators import retrieval, syntax


def sources(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    return rows.withColumn("language", language(F.col("path"), GRAPH_LANGUAGES))


def elements(files):
    return syntax.elements(syntax.blocks(syntax.statements(files)))


def test_chunks_are_the_lines_of_their_files(spark):
    files = sources(spark, {**FILES, "empty.cs": "", "null.cs": None})
    for most in (12, 512):
        chunks = {}
        for r in retrieval.code_chunks(files, elements(files), most).collect():
            chunks.setdefault(r["path"], []).append(r)
        assert set(chunks) == set(FILES)
        for path, rows in chunks.items():
            lines, covered = FILES[path].split("\n"), set()
            for r in rows:
                assert r["text"] == "\n".join(lines[r["start_line"] - 1 : r["end_line"]])
                assert len(r["text"]) // 4 <= most or r["start_line"] == r["end_line"]
                own = set(range(r["start_line"], r["end_line"] + 1))
                assert not own & covered
                covered |= own
            assert all(not lines[i - 1].strip() for i in set(range(1, len(lines) + 1)) - covered)
    own = {(r["component_id"].split("::")[-1], r["type"]): (r["start_line"], r["end_line"]) for r in chunks["api/Shop.cs"] if r["type"] == "Method"}
    assert own["OrderController.Run", "Method"] == (17, 28)


def test_index_after_changes_equals_a_new_one(spark):
    changed = {**FILES, "c/lib.c": FILES["c/lib.c"].replace("a + b", "a - b") + "int last(void) { return 1; }\n", "new.cs": "class New { void Run() { } }"}
    del changed["web/api.ts"]

    def index(files):
        df = sources(spark, files)
        return retrieval.index_code(df, elements(df), "repo", 20)

    delta = sources(spark, {"c/lib.c": changed["c/lib.c"], "new.cs": changed["new.cs"], "web/api.ts": None})
    other = index({"c/lib.c": "int other;"}).withColumn("payload", F.map_concat(F.map_filter("payload", lambda k, v: k != "repoPath"), F.create_map(F.lit("repoPath"), F.lit("elsewhere"))))
    got = retrieval.reindexed_code(index(FILES).unionByName(other), delta, elements(delta), "repo", 20)
    rows = lambda df: sorted((r["doc_id"], r["text"], tuple(sorted(r["payload"].items()))) for r in df.collect())
    assert rows(got) == sorted(rows(index(changed)) + rows(other))
    assert {k for r in got.collect() for k in r["payload"]} == {"repoPath", "filePath", "componentId", "componentType", "startLine", "endLine", "documentType"}
