"""The evidence graph: nodes of parsed pages, structural and semantic edges, checks and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import slug

#: Block types without a node; they still take a block index.
AUXILIARY = ("header", "footer", "page_number", "aside", "nav")


def element_nodes(blocks: DataFrame) -> DataFrame:
    """Nodes of ``blocks(doc_key, page_index, block_index, type, ...)`` with element_index, counting kept ones, and id."""
    kept = blocks.where(~F.col("type").isin(*AUXILIARY))
    index = F.row_number().over(Window.partitionBy("doc_key", "page_index").orderBy("block_index")) - 1
    return kept.withColumn("element_index", index).withColumn(
        "id", F.concat_ws(":", "doc_key", F.lit("page"), F.col("page_index"), F.lit("block"), F.col("block_index"), F.col("type"))
    )


def page_nodes(pages: DataFrame) -> DataFrame:
    """One node per ``(doc_key, page_index)``."""
    return pages.select("doc_key", "page_index", F.concat_ws(":", "doc_key", F.lit("page"), "page_index").alias("id")).distinct()


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Weight of containment: width times height, each at least 1; 1 without a box."""
    return F.coalesce(F.greatest(F.lit(1), x1 - x0) * F.greatest(F.lit(1), y1 - y0), F.lit(1)).cast("double")


def containment(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    p = pages.select("doc_key", "page_index", F.col("id").alias("source"))
    return nodes.join(p, ["doc_key", "page_index"]).select("doc_key", "source", F.col("id").alias("target"), F.lit("contains").alias("relation"), area(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("weight"))


def reading_order(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Edges between followers in a document's order; for elements it goes on across pages."""
    following = nodes.withColumn("target", F.lead("id").over(Window.partitionBy("doc_key").orderBy(*order)))
    return following.where("target is not null").select("doc_key", F.col("id").alias("source"), "target", F.lit("next").alias("relation"), F.lit(1.0).alias("weight"))


def layout(nodes: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest elements of a page beside each: vertical overlap, disjoint horizontally; weight 1/(1+d)."""
    a = nodes.select("doc_key", "page_index", *[F.col(c).alias(f"a_{c}") for c in ("id", "block_index", "x0", "y0", "x1", "y1")])
    b = nodes.select("doc_key", "page_index", *[F.col(c).alias(f"b_{c}") for c in ("id", "block_index", "x0", "y0", "x1", "y1")])
    beside = (F.least("a_y1", "b_y1") > F.greatest("a_y0", "b_y0")) & ((F.col("a_x1") <= F.col("b_x0")) | (F.col("b_x1") <= F.col("a_x0")))
    pairs = a.join(b, ["doc_key", "page_index"]).where((F.col("a_id") != F.col("b_id")) & beside)
    dx, dy = (F.col("a_x0") + F.col("a_x1") - F.col("b_x0") - F.col("b_x1")) / 2, (F.col("a_y0") + F.col("a_y1") - F.col("b_y0") - F.col("b_y1")) / 2
    pairs = pairs.withColumn("d", F.sqrt(dx * dx + dy * dy))
    near = Window.partitionBy("doc_key", "page_index", "a_id").orderBy(F.round("d", 9), "b_block_index")
    return pairs.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select(
        "doc_key", F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.when(F.col("a_x1") <= F.col("b_x0"), "right_of").otherwise("left_of").alias("relation"), (1 / (1 + F.col("d"))).alias("weight")
    )


def sections(nodes: DataFrame) -> DataFrame:
    """Heading edges within a page: a block to the latest title, a title to the last one before of a smaller level."""
    by_page = Window.partitionBy("doc_key", "page_index").orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.col("type") == "title"
    blocks = nodes.withColumn("parent", F.last(F.when(title, F.col("id")), ignorenulls=True).over(by_page)).where(~title)
    titles = nodes.where(title).select("doc_key", "page_index", "id", "block_index", "level")
    above = titles.select("doc_key", "page_index", F.col("id").alias("up_id"), F.col("block_index").alias("up_at"), F.col("level").alias("up_level"))
    under = titles.join(above, ["doc_key", "page_index"]).where("up_at < block_index and up_level < level").groupBy("doc_key", "id").agg(F.max_by("up_id", "up_at").alias("parent"))
    return blocks.where("parent is not null").select("doc_key", F.col("parent").alias("source"), F.col("id").alias("target")).unionByName(under.select("doc_key", F.col("parent").alias("source"), F.col("id").alias("target"))).withColumn("relation", F.lit("section"))


def edge_ids(edges: DataFrame, order: str) -> DataFrame:
    """Edge ids of type, relation and end slugs, numbered within equal ones by file order."""
    key = F.concat_ws(":", F.lit("edge"), "type", "relation", slug(F.col("source")), slug(F.col("target")))
    keyed = edges.withColumn("key", key)
    return keyed.withColumn("id", F.concat_ws(":", "key", F.row_number().over(Window.partitionBy("key").orderBy(order)) - 1)).drop("key")


def adjacency(edges: DataFrame, order: str) -> DataFrame:
    """``(node, out_edges, in_edges)`` lists of edge ids in file order."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "id"))), lambda x: x["id"]).alias("out_edges"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "id"))), lambda x: x["id"]).alias("in_edges"))
    none = F.array().cast("array<string>")
    return out.join(into, "node", "full").select("node", F.coalesce("out_edges", none).alias("out_edges"), F.coalesce("in_edges", none).alias("in_edges"))


def usable_edges(edges: DataFrame, nodes: DataFrame, relations: list[str], cap: int, order: str) -> DataFrame:
    """Edges with both ends present, of the mode's relations, at most ``cap`` a source in file order."""
    ids = nodes.select(F.col("id").alias("known"))
    kept = edges.where(F.col("relation").isin(relations)).join(ids, F.col("source") == F.col("known"), "left_semi").join(ids, F.col("target") == F.col("known"), "left_semi")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(order))).where(F.col("n") <= cap).drop("n")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    ids = nodes.select(F.col("id").alias("known"))
    lost = lambda end: edges.join(ids, F.col(end) == F.col("known"), "left_anti").withColumn("missing", F.lit(end))
    return lost("source").unionByName(lost("target"))


def follow(frontier: DataFrame, edges: DataFrame, by: str, node: str, bidirectional: bool = True) -> DataFrame:
    """``(by, from_node, node, relation)`` one step from each frontier node, against the direction too if asked."""
    steps = edges.select(F.col("source").alias("s"), F.col("target").alias("t"), "relation")
    if bidirectional:
        steps = steps.unionByName(edges.select(F.col("target").alias("s"), F.col("source").alias("t"), "relation"))
    return frontier.join(steps, F.col(node) == F.col("s")).select(by, F.col("s").alias("from_node"), F.col("t").alias(node), "relation")


def restore_abstracts(nodes: DataFrame, old: DataFrame) -> DataFrame:
    """Nodes with the abstract of an older build where that isn't empty."""
    before = old.select(F.col("id").alias("old_id"), F.nullif(F.col("abstract"), F.lit("")).alias("old_abstract"))
    return nodes.join(before, F.col("id") == F.col("old_id"), "left").withColumn("abstract", F.coalesce("old_abstract", "abstract")).drop("old_id", "old_abstract")
