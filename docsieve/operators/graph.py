"""Reference graphs: extraction of references, resolution, edges, traversal.

A traversal is one join a step, with the reached set kept as a table; the depth is a parameter, so plans stay bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

#: Reference patterns with the group that is kept.
PATTERNS = {
    "url": (r"""https?://[^\s<>"]+|www\.[^\s<>"]+""", 0),
    "file": (r"""(?i)(?:see|refer to|check)\s+(['"])(.*?\.(?:txt|pdf|doc|docx))\1""", 2),
    "section": (r"(?i)(?:see|as shown in|described in)\s+(?:section|chapter)\s+[\d\.]+", 0),
    "citation": (r"\[([\d,\s]+)\]|\(\w+\s*(?:et al\.?)?,\s*\d{4}\)", 1),
}
#: An edge of several types keeps the last of these.
PRIORITY = ("url", "file", "section", "citation")


def references(text: Column, kind: str) -> Column:
    """All references of a kind; an author-year citation gives ''."""
    pattern, group = PATTERNS[kind]
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def section_number(reference: Column) -> Column:
    """The number of a section reference without its lead-in words."""
    return F.regexp_replace(F.regexp_extract(reference, r"([\d\.]+)$", 1), r"\.$", "")


def extracted(docs: DataFrame) -> DataFrame:
    """``id, kind, ref`` of docs(id, content), each once."""

    def tagged(kind: str) -> Column:
        return F.transform(references(F.col("content"), kind), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))

    each = F.array(*map(tagged, PRIORITY))
    return docs.select("id", F.explode(F.flatten(each)).alias("r")).select("id", "r.*").distinct()


def build_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, title, type, metadata`` and edges ``src, dst, type`` of docs(id, filename, content_type, content,
    metadata map). A file resolves by name in any case, others by the metadata key of their kind; the first document
    wins, an edge keeps its last type, and a document may refer to itself."""
    nodes = docs.select("id", F.col("filename").alias("title"), F.col("content_type").alias("type"), "metadata")
    by_name = docs.select(F.lit("file").alias("kind"), F.lower("filename").alias("key"), "id")
    known = docs.select("id", F.explode("metadata").alias("kind", "key")).filter(F.col("kind").isin("url", "section", "citation"))
    target = by_name.unionByName(known.select("kind", "key", "id")).groupBy("kind", "key").agg(F.min("id").alias("dst"))
    refs = extracted(docs).select(F.col("id").alias("src"), "kind", F.when(F.col("kind") == "file", F.lower("ref")).otherwise(F.col("ref")).alias("key"))
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))
    edges = refs.join(target, ["kind", "key"]).groupBy("src", "dst").agg(F.max_by("kind", order).alias("type"))
    return nodes, edges


def levels(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``root, id, level``: nodes within ``depth`` undirected steps of each root of ``start(root)``."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    both = stored(both, "links")  # computed once, not once a step
    reached = start.select("root", F.col("root").alias("id"), F.lit(0).alias("level"))
    front = reached
    for step in range(1, depth + 1):
        nxt = front.join(both, front.id == both.a).select("root", F.col("b").alias("id")).distinct()
        front = stored(nxt.join(reached, ["root", "id"], "left_anti").withColumn("level", F.lit(step)), "front")
        reached = reached.unionByName(front)
    return reached


def related(edges: DataFrame, start: DataFrame, depth: int = 2, types: Sequence[str] | None = None) -> DataFrame:
    """Nodes near each root with their distance, in no order; with ``types`` only edges of these count."""
    if types is not None:
        edges = edges.filter(F.col("type").isin(list(types)))
    return levels(edges, start, depth).filter("level > 0").select("root", "id", F.col("level").alias("distance"))


def path_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """``root, id, src, dst, type``: for each reached node (root, id, level) an edge, in its true direction, to a node one
    level nearer: of several, the one to the smallest such node, then the smallest ends and type."""
    e = edges.select("src", "dst", "type")
    step = reached.filter("level > 0")
    ends = step.join(e, F.col("id") == F.col("src")).withColumn("_near", F.col("dst")).unionByName(step.join(e, F.col("id") == F.col("dst")).withColumn("_near", F.col("src")))
    near = reached.select("root", F.col("id").alias("_near"), (F.col("level") + 1).alias("level"))
    hit = ends.join(near, ["root", "_near", "level"])
    return hit.groupBy("root", "id").agg(F.min(F.struct("_near", "src", "dst", "type")).alias("e")).select("root", "id", "e.src", "e.dst", "e.type")


def common_references(edges: DataFrame, nodes: DataFrame, ids: Sequence[int]) -> DataFrame:
    """``dst, reference_count, types``: what all the documents refer to; empty if one of them is unknown."""
    wanted = sorted(set(ids))
    known = nodes.filter(F.col("id").isin(wanted)).agg(F.countDistinct("id").alias("known"))
    hits = edges.filter(F.col("src").isin(wanted)).groupBy("dst").agg(
        F.countDistinct("src").alias("reference_count"), F.array_sort(F.collect_set("type")).alias("types")
    )
    return hits.filter(F.col("reference_count") == len(wanted)).crossJoin(F.broadcast(known)).filter(F.col("known") == len(wanted)).drop("known")


def citation_graph(edges: DataFrame, start: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes with levels, and the edges both of whose ends are among them."""
    found = levels(edges, start, radius)
    inside = found.select("root", "id")
    e = edges.join(inside.select("root", F.col("id").alias("src")), "src")
    return found, e.join(inside.select("root", F.col("id").alias("dst")), ["root", "dst"]).select("root", "src", "dst", "type")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("reference_count"), F.array_sort(F.collect_list("type")).alias("reference_types"))


def serialised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as lines of JSON, ``kind, line``: a node (id, title, type, metadata) or an edge (source, target, type) each,
    so that a graph of any size can be written and read in parts."""
    node = F.struct("id", "title", "type", "metadata")
    edge = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")
    return nodes.select(F.lit("node").alias("kind"), F.to_json(node).alias("line")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(edge).alias("line")))


def deserialised(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges back from ``kind, line``."""
    read = lambda kind, schema: lines.filter(F.col("kind") == kind).select(F.from_json("line", schema).alias("x")).select("x.*")
    edges = read("edge", "source long, target long, type string")
    return read("node", "id long, title string, type string, metadata map<string,string>"), edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "type")
