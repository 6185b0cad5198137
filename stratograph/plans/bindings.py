"""Bindings of queries to base tables, and their SQL side as common table expressions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prose import WORDS
from ..sources.model import ARCS, NODES
from ..sources.tables import table

_TABLES = {t: t for t in ("region", "nation", "customer", "supplier", "part", "lineitem")}


def _duck(sql: str) -> str:
    return sql.format(**_TABLES).replace("as string)", "as varchar)")


GRAPH = f"""WITH RECURSIVE nodes AS ({_duck(NODES)}), arcs AS ({_duck(ARCS)}),
edges AS (SELECT src, dst, arg_min(type, seq) AS type, arg_min(strength, seq) AS strength FROM arcs GROUP BY src, dst),
adjacency AS (SELECT src, dst FROM arcs)
"""


def on_graph(select: str, *more: str) -> str:
    """A statement over nodes, arcs, edges and adjacency, with further expressions before it."""
    return GRAPH + "".join(f", {m}" for m in more) + " " + select


#: Names in each benchmark item: a first word, the first two, two about a comma, three about a full stop.
NAME_SHAPES = (r"^\p{Lu}\p{L}+", r"^\p{L}+ \p{L}+", r"\p{L}+, \p{L}+", r"\p{L}+\.\s\p{L}+ \p{L}+")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, name): names of one to three words in benchmark items, longer than two
    characters and with different words at their ends."""
    found = F.explode(F.array(*[F.regexp_extract("text", p, 0) for p in NAME_SHAPES])).alias("name")
    rows = table(spark, sf_dir, "benchmark").select("item_id", found).filter("length(name) > 2")
    ends = F.regexp_extract("name", r"^\p{L}+", 0) != F.regexp_extract("name", r"\p{L}+$", 0)
    return rows.filter(ends | F.col("name").rlike(r"^\p{L}+$")).distinct()


#: names (item_id, name) as above, and occurrences (doc_id, name, start) in documents, by runs of 1, 3 and 5 tokens.
OCCURRENCES = rf"""names AS (SELECT DISTINCT item_id, name FROM (SELECT item_id, unnest([{", ".join(f"regexp_extract(text, '{p}')" for p in NAME_SHAPES)}]) AS name FROM benchmark)
  WHERE length(name) > 2 AND (regexp_extract(name, '^\p{{L}}+') <> regexp_extract(name, '\p{{L}}+$') OR regexp_full_match(name, '\p{{L}}+'))),
tokens AS (SELECT doc_id, unnest(w) AS k, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{WORDS}|[^{WORDS[1:-2]}]+') AS w FROM documents)),
token_runs AS (SELECT doc_id, sum(length(k)) OVER w - length(k) AS start, k AS r1, k || lead(k, 1) OVER w || lead(k, 2) OVER w AS r3, k || lead(k, 1) OVER w || lead(k, 2) OVER w || lead(k, 3) OVER w || lead(k, 4) OVER w AS r5
  FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
occurrences AS (SELECT doc_id, name, start::BIGINT AS start FROM (SELECT doc_id, start, unnest([r1, r3, r5]) AS name FROM token_runs) SEMI JOIN names USING (name))"""
