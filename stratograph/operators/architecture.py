"""Layers, patterns and quality of modules, and the decision to split them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.model import Graph
from ..sources.tables import cut
from .folds import folded

#: Keywords of each layer, in the order they are tried.
LAYERS = {
    "Presentation": ("Controller", "View", "Page", "DTO", "ViewModel", "Presenter", "Component", "Screen", "Route"),
    "Application": ("Service", "Manager", "Handler", "UseCase", "Command", "Query", "Workflow", "Orchestrator"),
    "Domain": ("Entity", "Domain", "ValueObject", "Aggregate", "Model", "Core", "Shared", "Interfaces"),
    "Data": ("Repository", "DbContext", "Dao", "Storage", "Cache", "Database", "Sql", "Mongo", "Redis"),
    "Infrastructure": ("Gateway", "Client", "Adapter", "Proxy", "External", "Infra", "Config"),
    "CrossCutting": ("Util", "Helper", "Extensions", "Common", "Logging", "Security", "Auth", "Exception"),
}
#: Where arcs of a layered module may lead.
FLOWS = {"Presentation": ("Application", "Domain"), "Application": ("Domain", "Infrastructure", "Data"), "Infrastructure": ("Domain", "Data")}
#: Keywords of patterns.
SERVICE, NOT_SERVICE = ("Service", "API", "Microservice"), ("ApplicationService", "DomainService")
EVENT = ("Event", "Message", "Bus", "Queue", "Topic", "Publisher", "Subscriber", "Handler", "Listener")
EVENT_TARGET = ("Event", "Message", "Handler")
MODEL, VIEW, CONTROLLER = ("Model",), ("View", "Page", "Razor"), ("Controller",)
#: The layer of a component type in diagrams.
DIAGRAM_LAYERS = {"controller": "Presentation", "service": "Business", "repository": "Data", "interface": "Contract", "class": "Domain", "enum": "Domain", "api": "Presentation"}


def _regex(words: tuple[str, ...]) -> str:
    return "|".join(w.lower() for w in words)


def mentions(words: tuple[str, ...], node_id: str = "node_id", kind: str = "type") -> Column:
    """Any word occurs in the id or the type, whatever the case."""
    return F.lower(node_id).rlike(_regex(words)) | F.lower(kind).rlike(_regex(words))


def layer(node_id: str = "node_id", kind: str = "type") -> Column:
    out = None
    for name, words in LAYERS.items():
        test = mentions(words, node_id, kind)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Unknown")


def _mentions_sql(words: tuple[str, ...], node_id: str = "node_id", kind: str = "type") -> str:
    return f"(regexp_matches(lower({node_id}), '{_regex(words)}') OR regexp_matches(lower({kind}), '{_regex(words)}'))"


def layer_sql(node_id: str, kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {_mentions_sql(w, node_id, kind)} THEN '{n}'" for n, w in LAYERS.items()) + " ELSE 'Unknown' END"


def diagram_layer(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DIAGRAM_LAYERS.items() for x in pair])
    return F.coalesce(table[F.lower(kind)], F.lit("Unknown"))


def _arcs_by_module(graph: Graph, members: DataFrame) -> DataFrame:
    a = members.select(F.col("node_id").alias("src"), F.col("community").alias("ca"))
    b = members.select(F.col("node_id").alias("dst"), F.col("community").alias("cb"))
    return graph.adjacency.join(a, "src", "left").join(b, "dst", "left")


def module_quality(graph: Graph, members: DataFrame) -> DataFrame:
    """One row per community: cohesion, coupling, instability, abstractness, distance from
    the main sequence and maintainability; arcs counted with repeats, from both ends."""
    arcs = _arcs_by_module(graph, members)
    same = F.col("ca").eqNullSafe(F.col("cb"))
    out = arcs.groupBy(F.col("ca").alias("community")).agg(F.count_if(same).alias("inner"), F.count_if(~same).alias("ce"))
    into = arcs.filter(~same).groupBy(F.col("cb").alias("community")).agg(F.count("*").alias("ca"))
    abstract = F.lower("type").contains("interface") | F.lower("type").contains("abstract")
    size = members.join(graph.nodes, "node_id").groupBy("community").agg(F.count("*").alias("n"), F.sum("complexity").alias("c"), F.count_if(abstract).alias("abstract"))
    rows = size.join(out, "community", "left").join(into, "community", "left").fillna(0, ["inner", "ce", "ca"])
    n, across = F.col("n"), F.col("ce") + F.col("ca")
    whole = F.col("inner") + across
    rows = rows.select(
        "community",
        F.when(n > 1, F.col("inner") / (n * (n - 1))).otherwise(1.0).alias("cohesion"),
        F.when(whole > 0, across / whole).otherwise(0.0).alias("coupling"),
        F.when(across > 0, F.col("ce") / across).otherwise(0.0).alias("instability"),
        (F.col("abstract") / n).alias("abstractness"),
        "c",
    )
    return rows.withColumns(
        {
            "distance": F.abs(F.col("abstractness") + F.col("instability") - 1),
            "maintainability": F.greatest(F.lit(0.0), 100 - F.col("coupling") * 20 - F.col("c") / 10.0),
        }
    )


def semantic_diversity(graph: Graph, members: DataFrame) -> DataFrame:
    """(community, diversity): .4 directories + .3 types + .3 (1 - inner arcs / possible)."""
    folder = F.regexp_replace("file_path", r"[/\\][^/\\]*$", "")
    size = members.join(graph.nodes, "node_id").groupBy("community").agg(F.count("*").alias("n"), F.countDistinct(folder).alias("d"), F.countDistinct("type").alias("t"))
    inner = _arcs_by_module(graph, members).filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("i"))
    rows = size.join(inner, "community", "left").fillna(0, ["i"])
    n = F.col("n")

    def spread(count: str, per: int) -> Column:
        return F.least(F.lit(1.0), F.col(count) / F.greatest(F.lit(1), F.floor(n / per)))

    value = spread("d", 2) * 0.4 + spread("t", 3) * 0.3 + (1 - F.col("i") / (n * (n - 1))) * 0.3
    return rows.select("community", F.when(n <= 1, 0.0).otherwise(value).alias("diversity"))


def delegation(modules: DataFrame, most_depth: int = 3, most_tokens: int = 32768, most_complexity: int = 100, most_diversity: float = 0.6, enabled: bool = True) -> DataFrame:
    """Rows (n, depth, est_tokens, complexity, diversity, ...) with ``decision``, first reason first."""
    n = F.col("n")
    decision = (
        F.when(F.lit(not enabled), "none")
        .when(F.col("depth") >= most_depth, "max_depth")
        .when(n <= 1, "none")
        .when(F.col("est_tokens") > most_tokens, "token_limit")
        .when(F.col("complexity") > most_complexity, "complexity")
        .when((F.col("diversity") > most_diversity) & (n >= 4), "semantic_diversity")
        .otherwise("none")
    )
    return modules.withColumn("decision", decision)


def thirds(members: DataFrame) -> DataFrame:
    """(community, node_id, part): consecutive ids in parts of max(2, n / 3)."""
    w = Window.partitionBy("community")
    n = F.count("*").over(w)
    nth = F.row_number().over(w.orderBy("node_id")) - 1
    return members.select("community", "node_id", F.floor(nth / F.greatest(F.lit(2), F.floor(n / 3))).cast("int").alias("part"))


def patterns(graph: Graph, members: DataFrame) -> DataFrame:
    """(community, pattern, confidence): Microservices, Event-Driven, Clean Architecture,
    Model-View-Controller, Layered Architecture, in that order, else Unknown."""
    flags = graph.nodes.select("node_id", "type").join(members.select("node_id", "community"), "node_id", "left").withColumn("layer", layer())
    flags = flags.withColumn("service", mentions(SERVICE) & ~mentions(NOT_SERVICE)).withColumn("event", mentions(EVENT)).withColumn("target", mentions(EVENT_TARGET))
    flags = flags.select("*", *[mentions(words).alias(name) for name, words in (("m", MODEL), ("v", VIEW), ("c", CONTROLLER))]).drop("type")
    flags = cut(flags, "flags")  # every pattern is matched once a node; the arcs join narrow rows
    nodes = flags.filter("community is not null")
    size = nodes.groupBy("community").agg(
        F.count("*").alias("n"),
        F.count_if("service").alias("services"),
        F.count_if("event").alias("events"),
        F.count_if(F.col("layer") == "Domain").alias("domains"),
        F.countDistinct(F.when(F.col("layer") != "Unknown", F.col("layer"))).alias("layers"),
        *[F.max(name).alias(name) for name in "mvc"],
    )
    a = nodes.select(F.col("node_id").alias("src"), "community", "service", "event", "layer")
    b = flags.select(F.col("node_id").alias("dst"), "target", F.col("community").alias("other"), F.col("service").alias("service_b"), F.col("layer").alias("to"))
    arcs = graph.adjacency.join(a, "src").join(b, "dst")
    same = F.coalesce(F.col("community") == F.col("other"), F.lit(False))
    allowed = F.lit(False)
    for source, to in FLOWS.items():
        allowed = allowed | ((F.col("layer") == source) & F.col("to").isin(*to))
    flow = same & (F.col("layer") != "Unknown") & (F.col("to") != "Unknown") & (F.col("layer") != F.col("to"))
    links = arcs.groupBy("community").agg(
        F.countDistinct(F.when(same & F.col("service") & F.col("service_b") & (F.col("src") != F.col("dst")), F.struct("src", "dst"))).alias("service_links"),
        F.count_if(F.col("event") & F.col("target")).alias("event_links"),
        F.count_if(same & (F.col("layer") == "Domain") & ~F.col("to").isin("Domain", "CrossCutting", "Unknown")).alias("violations"),
        F.count_if(flow).alias("flows"),
        F.count_if(flow & allowed).alias("right"),
    )
    rows = size.join(links, "community", "left").fillna(0, ["service_links", "event_links", "violations", "flows", "right"])
    connected = F.col("service_links") / (F.col("services") * (F.col("services") - 1))
    share = F.col("events") / F.col("n")
    right = F.col("right") / F.col("flows")
    found = [
        ("Microservices", (F.col("services") >= 2) & (connected < 0.2), F.lit(0.8)),
        ("Microservices", (F.col("services") >= 2) & (connected < 0.4), F.lit(0.5)),
        ("Event-Driven", (share > 0.25) | ((F.col("events") >= 3) & (F.col("event_links") >= 1)), F.least(F.lit(0.9), share + 0.5)),
        ("Clean Architecture", (F.col("domains") > 0) & (F.col("violations") == 0), F.lit(0.85)),
        ("Model-View-Controller", F.col("m") & F.col("v") & F.col("c"), F.lit(0.9)),
        ("Model-View-Controller", (F.col("m") | F.col("v")) & F.col("c"), F.lit(0.6)),
        ("Layered Architecture", (F.col("flows") > 0) & (F.col("layers") >= 2) & (right > 0.5), right),
    ]
    first = F.coalesce(*[F.when(test, F.struct(F.lit(name).alias("p"), conf.cast("double").alias("q"))) for name, test, conf in found], F.struct(F.lit("Unknown").alias("p"), F.lit(0.0).alias("q")))
    return rows.select("community", first["p"].alias("pattern"), first["q"].alias("confidence"))


def pattern_sql() -> str:
    """The same over tables m (node_id, community), nodes and adjacency."""
    allowed = " OR ".join(f"(s.layer = '{k}' AND t.layer IN ({', '.join(repr(x) for x in v)}))" for k, v in FLOWS.items())
    return f"""SELECT community, p[1] AS pattern, round(p[2]::DOUBLE, 6) AS confidence FROM (SELECT community, CASE
      WHEN services >= 2 AND sl / (services * (services - 1.0)) < 0.2 THEN ['Microservices', '0.8']
      WHEN services >= 2 AND sl / (services * (services - 1.0)) < 0.4 THEN ['Microservices', '0.5']
      WHEN events / n::DOUBLE > 0.25 OR (events >= 3 AND el >= 1) THEN ['Event-Driven', least(0.9, 0.5 + events / n::DOUBLE)::VARCHAR]
      WHEN domains > 0 AND coalesce(bad, 0) = 0 THEN ['Clean Architecture', '0.85']
      WHEN m AND v AND c THEN ['Model-View-Controller', '0.9'] WHEN (m OR v) AND c THEN ['Model-View-Controller', '0.6']
      WHEN flows > 0 AND layers >= 2 AND good / flows::DOUBLE > 0.5 THEN ['Layered Architecture', (good / flows::DOUBLE)::VARCHAR] ELSE ['Unknown', '0'] END AS p
    FROM (SELECT community, count(*) AS n, count(*) FILTER (service) AS services, count(*) FILTER (event) AS events, count(*) FILTER (layer = 'Domain') AS domains,
        count(DISTINCT layer) FILTER (layer <> 'Unknown') AS layers, bool_or(m) AS m, bool_or(v) AS v, bool_or(c) AS c FROM x GROUP BY community)
    LEFT JOIN (SELECT s.community, count(DISTINCT (e.src, e.dst)) FILTER (same AND s.service AND t.service AND e.src <> e.dst) AS sl, count(*) FILTER (s.event AND t.target) AS el,
        count(*) FILTER (same AND s.layer = 'Domain' AND t.layer NOT IN ('Domain', 'CrossCutting', 'Unknown')) AS bad,
        count(*) FILTER (same AND s.layer <> 'Unknown' AND t.layer <> 'Unknown' AND s.layer <> t.layer) AS flows,
        count(*) FILTER (same AND s.layer <> 'Unknown' AND t.layer <> 'Unknown' AND s.layer <> t.layer AND ({allowed})) AS good
      FROM adjacency e JOIN x s ON s.node_id = e.src JOIN x t ON t.node_id = e.dst, LATERAL (SELECT s.community = t.community AS same) GROUP BY s.community) USING (community))""".replace(
        "FROM x GROUP", f"FROM ({_PATTERN_NODES}) GROUP"
    ).replace("JOIN x ", f"JOIN ({_PATTERN_NODES}) ")


_PATTERN_NODES = f"""SELECT node_id, community, {layer_sql('node_id', 'type')} AS layer, {_mentions_sql(SERVICE)} AND NOT {_mentions_sql(NOT_SERVICE)} AS service,
  {_mentions_sql(EVENT)} AS event, {_mentions_sql(EVENT_TARGET)} AS target, {_mentions_sql(MODEL)} AS m, {_mentions_sql(VIEW)} AS v, {_mentions_sql(CONTROLLER)} AS c FROM m JOIN nodes USING (node_id)"""


def cluster_names(graph: Graph, members: DataFrame, root: str = "") -> DataFrame:
    """(community, name): the single directory, else a layer that 60 % share, else the common
    start of the directories, else Component_n_Files."""
    folder = F.regexp_replace("file_path", r"[/\\]?[^/\\]*$", "")
    rows = members.join(graph.nodes, "node_id").withColumn("folder", folder).withColumn("layer", layer())
    size = rows.groupBy("community").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("folder") != "", F.split("folder", r"[/\\]"))).alias("lo"),
        F.max(F.when(F.col("folder") != "", F.split("folder", r"[/\\]"))).alias("hi"),
    )
    shares = rows.filter("layer <> 'Unknown'").groupBy("community", "layer").agg(F.count("*").alias("k"))
    top = shares.groupBy("community").agg(F.max(F.struct("k", "layer")).alias("top"))
    rows = size.join(top, "community", "left")
    agree = F.transform(F.arrays_zip("lo", "hi"), lambda z: z["lo"] == z["hi"])
    length = F.coalesce(F.array_position(F.transform(agree, lambda x: F.coalesce(x, F.lit(False))), False).cast("int") - 1, F.lit(0))
    length = F.when(F.array_contains(F.transform(agree, lambda x: F.coalesce(x, F.lit(False))), False), length).otherwise(F.size("lo"))
    common = sanitised(F.array_join(F.slice("lo", F.lit(1), length), " "))
    single = F.col("lo") == F.col("hi")
    name = (
        F.when(single & F.col("lo").isNotNull(), sanitised(F.array_join("lo", " ")))
        .when(F.col("top.k") / F.col("n") >= 0.6, F.col("top.layer"))
        .when(F.col("lo").isNotNull() & (common != ""), common)
        .otherwise(F.concat(F.lit("Component_"), "n", F.lit("_Files")))
    )
    return rows.select("community", name.alias("name"))


def sanitised(path: Column) -> Column:
    return F.trim(F.translate(path, "/\\_", "   "))


def packed(members: DataFrame, most: float, tokens: str = "est_tokens") -> DataFrame:
    """Greedy packing in order of id: a node that would exceed ``most`` opens the next part."""

    def pack(state, row):
        part, size = state
        t = getattr(row, tokens)
        if size + t > most and size > 0:
            part, size = part + 1, 0.0
        return (part, size + t), part

    rows = members.select("community", "node_id", tokens)
    return folded(rows, "community", "node_id", lambda: (0, 0.0), pack, "part", "int").select("community", "node_id", "part")


def merge_siblings(modules: DataFrame, small: float = 4000, most: float = 32768) -> DataFrame:
    """(module_id, merged_into): leaves below ``small`` tokens join the next small sibling of
    their parent, in order of id, while their sum stays below ``most``."""

    def merge(state, row):
        head, size = state
        if not row.is_leaf or row.est_tokens >= small:
            return state, row.module_id
        if head is None or size + row.est_tokens >= most:
            head, size = row.module_id, 0.0
        return (head, size + row.est_tokens), head

    rows = modules.select("parent_id", "module_id", "est_tokens", "is_leaf")
    return folded(rows, "parent_id", "module_id", lambda: (None, 0.0), merge, "merged_into", "string").select("parent_id", "module_id", "merged_into")
