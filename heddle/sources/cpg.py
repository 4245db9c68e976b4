"""Raw graph exports (JSON of nodes and edges) as code property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.tables import materialized, numbered, union_all

# The export's fields, the kinds of edges and what they become, and the labels of declarations.
NODE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "label", "code", "name", "methodFullName", "fullName", "filename")] + [T.StructField(n, T.IntegerType()) for n in ("lineNumber", "columnNumber")])
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "dst", "kind")])
EXPORT = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
EDGE_KINDS = {"AST": "AST", "CFG": "CFG", "CDG": "PDG", "REACHING_DEF": "PDG"}
DECLARATIONS = ("METHOD", "TYPE_DECL")
OPERATOR = "<operator>."


def read_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of export files, one graph for each file; a file that isn't an export fails the read."""
    files = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("graph_id", F.input_file_name())
    return files.select("graph_id", F.inline("nodes")), files.select("graph_id", F.inline("edges"))


def invalid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose kind isn't known or whose ends aren't nodes, with the reason."""
    ids = nodes.select("graph_id", "id")
    unknown = edges.where(~F.coalesce(F.col("kind"), F.lit("")).isin(*EDGE_KINDS)).withColumn("reason", F.lit("unknown edge kind"))
    dangling = [edges.join(ids.withColumnRenamed("id", end), ["graph_id", end], "left_anti").select(*edges.columns).withColumn("reason", F.lit(f"dangling {end}")) for end in ("src", "dst")]
    return union_all([unknown, *dangling])


def mapped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, locations) of a graph for each export.

    The syntax tree is walked from its roots level by level: a child inherits its parent's file and
    declaration, and its structural path is the places from the last declaration down. Nodes are then
    numbered by file, line, column and pre-order place, so that the order of the export doesn't count.
    Nodes outside the tree come last in it, without declaration and path. Invalid edges raise.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    is_decl = F.col("label").isin(*DECLARATIONS)
    n = materialized(nodes.select("graph_id", "id", text("label").alias("label"), text("code").alias("code"), text("name").alias("name"), text("methodFullName").alias("call_name"), text("fullName").alias("own_name"), text("filename").alias("own_file"), number("lineNumber").alias("line"), number("columnNumber").alias("column")))
    edges = materialized(edges.select("graph_id", "src", "dst", "kind"))
    if not invalid_edges(n, edges).isEmpty():
        raise ValueError("an export has edges of unknown kind or without nodes")
    own = [c for c in n.columns if c not in ("graph_id", "id")]
    tree = edges.where("kind = 'AST'").select("graph_id", F.col("src").alias("parent"), F.col("dst").alias("id"))
    tree = materialized(tree.groupBy("graph_id", "id").agg(F.max("parent").alias("parent")))
    sibling = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("file", "line", "column", "id")) - 1
    file = F.when(F.col("own_file") != "", F.col("own_file")).otherwise(F.col("parent_file"))
    roots = n.join(tree, ["graph_id", "id"], "left_anti").withColumns({"parent_file": F.lit(""), "parent_decl": F.lit(""), "parent_path": F.lit(""), "walk": F.array().cast("array<int>")}).withColumn("file", file)
    roots = roots.withColumn("place", sibling("graph_id"))
    level, found = roots.withColumn("root", F.lit(True)), []
    while True:
        path = F.when(is_decl, "").when(F.col("root"), "").otherwise(F.when(F.col("parent_path") == "", F.col("place").cast("string")).otherwise(F.concat_ws(".", "parent_path", "place")))
        decl = F.when(is_decl, F.col("own_name")).otherwise(F.col("parent_decl"))
        level = materialized(level.select("graph_id", "id", *own, "file", decl.alias("decl"), path.alias("path"), F.concat("walk", F.array(F.col("place").cast("int"))).alias("walk")))
        if level.isEmpty():
            break
        found.append(level)
        above = level.select("graph_id", F.col("id").alias("parent"), F.col("file").alias("parent_file"), F.col("decl").alias("parent_decl"), F.col("path").alias("parent_path"), "walk")
        level = tree.join(above, ["graph_id", "parent"]).join(n, ["graph_id", "id"]).withColumn("file", file)
        level = level.withColumns({"place": sibling("graph_id", "parent"), "root": F.lit(False)})
    walked = union_all(found) if found else level
    orphans = n.join(walked, ["graph_id", "id"], "left_anti").select("graph_id", "id", *own, F.col("own_file").alias("file"), F.lit("").alias("decl"), F.lit("").alias("path"), F.array(F.lit(2**31 - 1)).alias("walk"))
    rows = walked.unionByName(orphans)
    # in ranges, so that a large graph isn't one task; a graph's first number is taken off
    placed = numbered(rows, ["graph_id", "file", "line", "column", "walk", "id"], "place")
    first = materialized(placed.groupBy("graph_id").agg(F.min("place").alias("first")))
    rows = placed.join(first, "graph_id").withColumn("node_id", F.col("place") - F.col("first")).drop("place", "first")
    value = F.when(F.col("label") == "LITERAL", F.col("code")).when((F.col("label") == "CALL") & F.col("name").startswith(OPERATOR), F.col("name")).otherwise("")
    fqn = F.when(F.col("label") == "CALL", F.col("call_name")).when(is_decl, F.col("own_name")).otherwise("")
    out = rows.select("graph_id", "node_id", F.col("label").alias("kind"), value.alias("operator_or_literal"), fqn.alias("resolved_fqn"), F.col("decl").alias("enclosing_decl_fqn"), F.col("path").alias("structural_path"))
    ids = rows.select("graph_id", "id", "node_id")
    kinds = F.create_map(*(F.lit(x) for kv in EDGE_KINDS.items() for x in kv))
    e = edges.join(ids.toDF("graph_id", "src", "s"), ["graph_id", "src"]).join(ids.toDF("graph_id", "dst", "d"), ["graph_id", "dst"])
    return out, e.select("graph_id", F.col("s").alias("src"), F.col("d").alias("dst"), kinds[F.col("kind")].alias("kind")), rows.select("graph_id", "node_id", "file", "line", "column")


def invalid_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, reason): ids that repeat, empty kinds, edges without nodes."""
    twice = nodes.groupBy("graph_id", "node_id").count().where("count > 1").select("graph_id", F.lit("repeated id").alias("reason"))
    empty = nodes.where("kind = ''").select("graph_id", F.lit("empty kind").alias("reason"))
    ends = [edges.join(nodes.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_anti").select("graph_id", F.lit(f"dangling {end}").alias("reason")) for end in ("src", "dst")]
    return union_all([twice, empty, *ends]).distinct()
