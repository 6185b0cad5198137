"""Vector collections: upsert, filtered top-K, deletion, indexing and context composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prose import fixed_chunks
from .folds import folded


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def collection(vectors: DataFrame, size: int) -> DataFrame:
    """The rows whose vector has the collection's size."""
    return vectors.filter(F.size("embedding") == size)


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Latest row of each key: a maximum over (seq), without sorting the rows of a key."""
    rows = old.unionByName(new)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("r")).select(key, "r.*")


def matching(payload: Column, wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (payload[k] == v)
    return out


def top_k(vectors: DataFrame, query: list[float], k: int, wanted: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, score, rank): cosine to one query vector, ties by id; payload must match.

    The query is a literal; each partition keeps k rows before they meet."""
    rows = vectors.filter(matching(F.col("payload"), wanted)) if wanted else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.withColumn("score", cosine(F.col("embedding"), q)).filter("score is not null").orderBy(F.desc("score"), "doc_id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def delete_collection(spark: SparkSession, path: str, name: str) -> None:
    """Drop a collection: its folder below ``path``.  A missing one is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={name}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete(vectors: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """What stays after deleting by payload; an empty filter deletes nothing."""
    return vectors.filter(~F.coalesce(matching(F.col("payload"), wanted), F.lit(False))) if wanted else vectors


def index_pages(pages: DataFrame, repo: str, size: int = 2048, overlap: int = 200) -> DataFrame:
    """(doc_id, text, payload): a row per chunk, with five payload keys."""
    rows = pages.select("page_id", "title", F.posexplode(fixed_chunks(F.col("content"), size, overlap)).alias("n", "text"))
    payload = F.create_map(
        F.lit("repoPath"), F.lit(repo), F.lit("pageId"), F.col("page_id").cast("string"), F.lit("pageTitle"), F.col("title"),
        F.lit("chunkIndex"), F.col("n").cast("string"), F.lit("type"), F.lit("documentation"),
    )
    return rows.select(F.concat_ws(":", F.col("page_id").cast("string"), F.col("n").cast("string")).alias("doc_id"), "text", payload.alias("payload"))


def code_chunks(files: DataFrame, elements: DataFrame, most: int = 512) -> DataFrame:
    """(path, component_id, type, start_line, end_line, text): files (path, content) cut along their elements.

    A line belongs to the innermost of ``elements`` (id, path, type, line, end_line) that holds
    it, of those that begin on one line the shortest, else to the file; lines of one owner next
    to each other are packed, in order, to ``most`` tokens of four characters a chunk, a longer
    line alone.  So the chunks of a file are all of its lines, each once.  Blank chunks and
    files without content have none."""
    lines = files.filter("content is not null").select("path", F.posexplode(F.split("content", "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")
    spans = elements.select("path", "id", "type", F.col("line").alias("first"), "end_line", F.explode(F.sequence("line", "end_line")).alias("line"))
    inner = spans.groupBy("path", "line").agg(F.max(F.struct("first", (-F.col("end_line")).alias("short"), "id", "type")).alias("own"))
    rows = lines.join(inner, ["path", "line"], "left").select("path", "line", "text", F.coalesce("own.id", "path").alias("component_id"), F.coalesce("own.type", F.lit("File")).alias("type"))
    of_file = Window.partitionBy("path").orderBy("line")
    change = F.coalesce((F.lag("component_id").over(of_file) != F.col("component_id")).cast("int"), F.lit(1))
    rows = rows.withColumn("run", change)
    rows = rows.withColumn("run", F.sum("run").over(of_file)).withColumn("key", F.concat_ws("#", "path", F.col("run").cast("string"))).withColumn("size", F.length("text") + 1)

    def pack(state, row):
        chunk, used = state
        if used and (used + row.size) // 4 > most:
            chunk, used = chunk + 1, 0
        return (chunk, used + row.size), chunk

    packed = folded(rows.drop("run"), "key", "line", lambda: (0, 0), pack, "chunk", "int")
    held = F.array_sort(F.collect_list(F.struct("line", "text")))
    out = packed.groupBy("path", "component_id", "type", "key", "chunk").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), held.alias("held"))
    return out.select("path", "component_id", "type", "start_line", "end_line", F.array_join("held.text", "\n").alias("text")).filter("trim(text) <> ''")


def index_code(files: DataFrame, elements: DataFrame, repo: str, most: int = 512) -> DataFrame:
    """(doc_id, text, payload): a row per chunk of code, with seven payload keys."""
    rows = code_chunks(files, elements, most)
    payload = F.create_map(
        F.lit("repoPath"), F.lit(repo), F.lit("filePath"), F.col("path"), F.lit("componentId"), F.col("component_id"), F.lit("componentType"), F.col("type"),
        F.lit("startLine"), F.col("start_line").cast("string"), F.lit("endLine"), F.col("end_line").cast("string"), F.lit("documentType"), F.lit("code"),
    )
    return rows.select(F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("doc_id"), "text", payload.alias("payload"))


def reindexed_code(index: DataFrame, changed: DataFrame, elements: DataFrame, repo: str, most: int = 512) -> DataFrame:
    """``index`` of code after a change: files of ``changed`` (path, content) have new chunks, those
    whose content is null are gone.  Only the changed files are cut; the others' rows stay."""
    own = F.col("payload")["repoPath"] == repo
    paths = changed.select(F.col("path").alias("_path")).distinct()
    stay = index.join(paths, (F.col("payload")["filePath"] == F.col("_path")) & own, "left_anti")
    return stay.unionByName(index_code(changed.filter("content is not null"), elements, repo, most))


def context(found: DataFrame) -> DataFrame:
    """One row: the ranked texts as numbered sources, titled by page, else file."""
    title = F.coalesce(F.col("payload")["pageTitle"], F.col("payload")["filePath"], F.lit("Unknown Source"))
    block = F.concat(F.lit("Source ["), F.col("rank").cast("string"), F.lit("]: "), title, F.lit("\n"), "text", F.lit("\n---\n"))
    rows = found.agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return rows.select(F.array_join("b.block", "").alias("context"))
