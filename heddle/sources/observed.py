"""Strict graph documents: every value keeps its native type, everything that is wrong is a row, and all candidates are kept.

A document is JSON with `nodes` (id, kind, properties, missing_properties) and `edges` (src, dst, kind,
properties). It is read into VARIANT, so a number in quotation marks is a string and 1.0 is no integer; nothing is
coerced. A catalogue (kind, name, native: str, int or bool, quantity: one, optional or many) says which properties a kind of node
has, another (kind, name; name null: none) which property a kind of edge may have; both are small tables of a format's
version that the caller gives.

`violations` lists what keeps documents from being used; `observations`, `role_edges`, `ownership` and the
lookups are for those that have none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.tables import materialized
from heddle.operators.governance import ENDS, wrong_ends

# Native types and what VARIANT calls them, and what parts of a method and relations of nodes are called.
NATIVE = {"str": "STRING", "int": "BIGINT", "bool": "BOOLEAN"}
FORMALS = ("METHOD_PARAMETER_IN", "METHOD_PARAMETER_OUT")
OWNED = (*FORMALS, "METHOD_RETURN")
METHOD_PARTS = (*OWNED, "MODIFIER")
RELATIONS = ("AST", "REF", "EVAL_TYPE", "CAPTURE", "BINDS", "INHERITS_FROM", "CFG", "CDG", "REACHING_DEF")
INT_RANGE = (-(2**31), 2**31 - 1)


@dataclass
class Documents:
    """rows: a document each (graph_id, nodes, edges: arrays, null where they are none); what meets in a document meets in its row."""

    rows: DataFrame
    catalogue: DataFrame
    edge_catalogue: DataFrame

    @property
    def nodes(self) -> DataFrame:
        """graph_id, ordinal, id, kind, properties (map of VARIANT), missing (array, null if it isn't one of strings)"""
        return _exploded(self.rows, "nodes").withColumn("missing", F.when(~F.exists("missing", F.isnull), F.col("missing")))

    @property
    def edges(self) -> DataFrame:
        """graph_id, ordinal, src, dst, kind, properties"""
        return _exploded(self.rows, "edges")

    @property
    def broken(self) -> DataFrame:
        """graph_id of what isn't such a document"""
        return self.rows.where("nodes IS NULL OR edges IS NULL").select("graph_id")


def _exploded(rows: DataFrame, name: str) -> DataFrame:
    # outer, as else the lists are made twice: once more for a filter that Spark adds
    items = rows.select("graph_id", F.posexplode_outer(name).alias("ordinal", "x")).where("ordinal IS NOT NULL")
    return items.select("graph_id", F.col("ordinal").cast("long").alias("ordinal"), "x.*")


def parsed(documents: DataFrame, catalogue: DataFrame, edge_catalogue: DataFrame) -> Documents:
    """documents: graph_id, json. Parsed wherever they are read, so for what reads them once; a document that isn't JSON, or in which an object has a key twice, is broken."""
    v = documents.select("graph_id", F.try_parse_json("json").alias("v"))
    props = "properties map<string, variant>"
    # of all that JSON has, only a string becomes binary, so a number isn't taken for one
    node, edge = f"id {{0}}, kind {{0}}, {props}, missing_properties array<{{0}}>", f"src {{0}}, dst {{0}}, kind {{0}}, {props}"
    lists = (F.try_variant_get("v", f"$.{n}", f"array<struct<{x.format('binary')}>>").cast(f"array<struct<{x.format('string').replace('missing_properties', 'missing')}>>").alias(n) for n, x in (("nodes", node), ("edges", edge)))
    return Documents(v.select("graph_id", *lists), catalogue, edge_catalogue)


def read(documents: DataFrame, catalogue: DataFrame, edge_catalogue: DataFrame) -> Documents:
    """The same, each document parsed once, into one written table."""
    d = parsed(documents, catalogue, edge_catalogue)
    return replace(d, rows=materialized(d.rows))


@F.udf(T.ArrayType(T.ArrayType(T.IntegerType())), useArrow=False)
def _all_at(keys: list[str | None], asked: list[str | None]) -> list[list[int] | None]:
    """Where each name that is asked for stands among the keys; null stands for null."""
    at: dict = {}
    for i, k in enumerate(keys):
        at.setdefault(k, []).append(i)
    return [at.get(a) for a in asked]


@F.udf(T.ArrayType(T.IntegerType()), useArrow=False)
def _at(keys: list[str | None], asked: list[str | None]) -> list[int | None]:
    """The same where the keys are distinct; null is nowhere."""
    at = {k: i for i, k in enumerate(keys) if k is not None}
    return [at.get(a) for a in asked]


def _wrong_type(value: Column, native: Column, quantity: Column) -> Column:
    """Whether a property isn't of its native type, as one value or as an array of them."""
    kinds = F.create_map(*(F.lit(x) for kv in NATIVE.items() for x in kv))
    fits = lambda v: (F.schema_of_variant(v) == kinds[native]) & ((native != "int") | F.coalesce(F.try_variant_get(v, "$", "bigint").between(*INT_RANGE), F.lit(False)))
    items = F.try_variant_get(value, "$", "array<variant>")
    many = F.schema_of_variant(value).startswith("ARRAY") & F.forall(items, lambda v: F.coalesce(fits(v), F.lit(False)))
    return ~F.coalesce(F.when(quantity == "many", many).otherwise(fits(value)), F.lit(False))


def _catalogues(d: Documents) -> DataFrame:
    """One row of both catalogues by kind: what is required, the properties, whether it is an expression; the property of an edge."""
    has = F.col("name") == "ARGUMENT_INDEX"
    of_kind = d.catalogue.where("kind IS NOT NULL").groupBy("kind").agg(
        F.sort_array(F.collect_list(F.when(F.col("quantity") == "one", F.col("name")))).alias("required"), F.collect_list(F.struct("name", "native", "quantity")).alias("properties"), F.coalesce(F.max(has), F.lit(False)).alias("is_expression")
    )
    of_edge = d.edge_catalogue.where("kind IS NOT NULL").groupBy("kind").agg(F.max("name").alias("name"))
    both = [df.agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct(*df.columns[1:])))).alias(name)) for df, name in ((of_kind, "kinds"), (of_edge, "edge_kinds"))]
    return both[0].crossJoin(F.broadcast(both[1]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value made once for a row; a column that lambdas name may be made again for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _met(d: Documents) -> DataFrame:
    """Documents with what meets at their nodes, as places in their arrays.

    src_at, dst_at: of the nodes with an edge's names; tree: its AST edges; names: what these lead to; into: for each name which of the tree do; parent_at: where the
    tree's parents stand among the names.
    """
    none = lambda c: F.coalesce(c, F.array().cast(d.rows.schema[c].dataType)).alias(c)
    rows = d.rows.select("graph_id", (F.col("nodes").isNull() | F.col("edges").isNull()).alias("broken"), none("nodes"), none("edges"))
    tree = F.filter(F.transform("edges", lambda e, i: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["kind"].alias("kind"), i.alias("edge"))), lambda e: e["kind"] == "AST")
    rows = rows.withColumn("tree", tree).withColumn("names", F.array_distinct("tree.dst"))
    return rows.withColumns({"src_at": _all_at("nodes.id", "edges.src"), "dst_at": _all_at("nodes.id", "edges.dst"), "into": _all_at("tree.dst", "names"), "parent_at": _at("names", "tree.src")})


def _with_ups(body: Callable[[Column], Column]) -> Column:
    """body of `ups`, for each name the edge (src, edge, at: where src is among the names) from its least parent, and `several`, whether there are other parents."""
    up = lambda j: F.struct(F.get("tree", j)["src"].alias("src"), F.get("tree", j)["edge"].alias("edge"), F.get("parent_at", j).alias("at"))
    every = F.transform("into", lambda js: F.filter(F.transform(js, up), lambda u: u["src"].isNotNull()))
    several = lambda us: F.array_min(us)["src"] < F.array_max(us)["src"]
    return _let(every, lambda x: _let(F.struct(F.transform(x, F.array_min).alias("ups"), F.transform(x, several).alias("several")), body))


def _kinds_at(places: Column, name: Column) -> Column:
    """The kinds of the nodes of a name, one that is null where there is no such node."""
    kinds = F.array_distinct(F.transform(F.when(name.isNotNull(), places), lambda p: F.get("nodes", p)["kind"]))
    return F.coalesce(kinds, F.array(F.lit(None).cast("string")))


def _doubled(state: Column, size: Column, step: Callable[[Column, Column], Column], left: Callable[[Column], Column]) -> Column:
    """An array of pointers into itself after as many rounds of step(state, pointer) as a chain of that size needs, as long as some are left."""
    rounds = F.ceil(F.log2(F.greatest(size, F.lit(1)) + 1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), rounds), state, lambda acc, _: F.when(F.exists(acc, left), F.transform(acc, lambda x: step(acc, x))).otherwise(acc))


def violations(d: Documents) -> DataFrame:
    """(graph_id, rule, subject): all that is wrong, subject being a node's id or place, an edge as src>dst, or a property as id.name.

    Nothing hides anything else: each rule is a filter of its own over a document's row, which is gone through where it is read.
    """
    rows = _met(d).crossJoin(F.broadcast(_catalogues(d)))
    owned = lambda x: x["id"].isNotNull() & x["kind"].isin(*OWNED)
    parts = F.array_distinct(F.transform(F.filter("nodes", owned), lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"))))
    links = F.filter("edges", lambda e: e["kind"] == "PARAMETER_LINK")
    rows = rows.withColumns({"parts": parts, "links": links})
    rows = rows.withColumns({"part_at": _at("names", "parts.id"), **{f"link_{e}_at": _at("names", f"links.{e}") for e in ("src", "dst")}})
    # pointers that have gone further than there are names are on a cycle
    rings = lambda m: F.array_compact(F.array_distinct(_doubled(m["ups"]["at"], F.size("names"), lambda acc, p: F.get(acc, p), lambda p: p.isNotNull())))
    return rows.select("graph_id", F.explode(_with_ups(lambda m: _let(rings(m), lambda r: _said(m, r)))).alias("x")).select("graph_id", "x.*")


def _said(m: Column, rings: Column) -> Column:
    """All that is wrong with a document, by rule; m: of `_with_ups`."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    node_name = lambda x, i: F.coalesce(x["id"], F.concat(F.lit("#"), i.cast("string")))
    edge_name = lambda e: F.concat_ws(">", F.coalesce(e["src"], F.lit("")), F.coalesce(e["dst"], F.lit("")))
    kind = lambda x: F.try_element_at("kinds", x["kind"])
    edge_kind = lambda e: F.try_element_at("edge_kinds", e["kind"])
    of_nodes = lambda bad: F.transform("nodes", lambda x, i: F.when(bad(x), node_name(x, i)))
    of_edges = lambda bad: F.transform(F.filter("edges", bad), edge_name)
    good_id = lambda x: x["id"].rlike("^(0|[1-9][0-9]*)$") & x["id"].try_cast("bigint").isNotNull()
    missing = lambda x: F.array_except(kind(x)["required"], F.coalesce(F.map_keys(x["properties"]), F.array().cast("array<string>")))
    as_said = lambda p, k: F.filter(k["properties"], lambda c: c["name"] == p["key"])
    of_properties = lambda bad: F.flatten(F.array_compact(F.transform("nodes", lambda x: F.transform(F.filter(F.map_entries(F.when(kind(x).isNotNull(), x["properties"])), lambda p: bad(p, kind(x))), lambda p: F.concat_ws(".", x["id"], p["key"])))))
    extra = lambda e: F.array_except(F.map_keys(e["properties"]), F.array_compact(F.array(edge_kind(e)["name"])))
    expression = lambda k: F.coalesce(F.try_element_at("kinds", k)["is_expression"], F.lit(False))
    rule = lambda e, a, b: wrong_ends({"kind": e["kind"], "src_kind": a, "dst_kind": b, "src_expr": expression(a), "dst_expr": expression(b)}.__getitem__)
    named = lambda e, r: F.when(r.isNotNull(), F.concat_ws(":", r, edge_name(e)))
    # most edges are of kinds without a rule for their ends, so only a missing one counts, or one without a kind
    ruled = lambda e, i, unsaid: unsaid | e["kind"].isin(*ENDS, "REF") | e["src"].isNull() | e["dst"].isNull() | F.get("src_at", i).isNull() | F.get("dst_at", i).isNull()
    ends = lambda e, i: F.flatten(F.transform(_kinds_at(F.get("src_at", i), e["src"]), lambda a: F.transform(_kinds_at(F.get("dst_at", i), e["dst"]), lambda b: named(e, rule(e, a, b)))))
    owners = F.transform("names", lambda n, i: F.when(F.get(m["several"], i), F.concat_ws(":", F.lit("owners"), F.concat_ws(">", F.get(m["ups"], i)["src"], F.coalesce(n, F.lit(""))))))
    up = lambda at: F.get(m["ups"], at)
    part = lambda x, i: F.transform(_kinds_at(F.get("src_at", up(F.get("part_at", i))["edge"]), up(F.get("part_at", i))["src"]), lambda k: F.when(k.isNull() | (k != "METHOD"), x["id"]))
    across = F.transform("links", lambda e, i: F.when(up(F.get("link_src_at", i))["src"] != up(F.get("link_dst_at", i))["src"], edge_name(e)))
    repeated = _let(F.array_sort(F.array_compact(F.col("nodes.id"))), lambda ids: F.array_distinct(F.filter(ids, lambda v, i: v == F.get(ids, i - 1))))
    meta = F.size(F.filter("nodes", lambda x: x["kind"] == "META_DATA"))
    said = {
        "bad_id": of_nodes(lambda x: no(good_id(x))),
        "repeated_id": repeated,
        "unknown_kind": of_nodes(lambda x: kind(x).isNull()),
        "no_properties": of_nodes(lambda x: x["properties"].isNull()),
        "unknown_property": of_properties(lambda p, k: F.size(as_said(p, k)) == 0),
        "wrong_type": of_properties(lambda p, k: F.exists(as_said(p, k), lambda c: _wrong_type(p["value"], c["native"], c["quantity"]))),
        "missing_not_explicit": of_nodes(lambda x: kind(x).isNotNull() & no(x["missing"] == missing(x))),
        "metadata": F.when((F.size("nodes") > 0) & (meta != 1), F.array(meta.cast("string"))),
        "unknown_edge_kind": of_edges(lambda e: edge_kind(e).isNull()),
        "unknown_edge_property": of_edges(lambda e: edge_kind(e).isNotNull() & (e["properties"].isNull() | (F.size(extra(e)) > 0))),
        "wrong_edge_property_type": of_edges(lambda e: edge_kind(e).isNotNull() & F.exists(F.map_values(e["properties"]), lambda v: F.schema_of_variant(v) != "STRING")),
        "ends": F.concat(_let(F.exists("nodes", lambda x: x["kind"].isNull()), lambda unsaid: F.flatten(F.array_compact(F.transform("edges", lambda e, i: F.when(ruled(e, i, unsaid), ends(e, i)))))), owners),
        "cyclic_ownership": F.transform(rings, lambda p: F.get("names", p)),
        "formal_without_method": F.flatten(F.transform("parts", part)),
        "link_across_methods": across,
    }
    none = F.array().cast("array<string>")
    says = lambda rule, subjects: F.transform(F.array_compact(F.coalesce(subjects, none)), lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("subject")))
    each = (says(rule, subjects) for rule, subjects in said.items())
    broken = F.when(F.col("broken"), F.array(F.struct(F.lit("not_a_document").alias("rule"), F.lit(None).cast("string").alias("subject")))).otherwise(F.array().cast("array<struct<rule:string,subject:string>>"))
    return F.concat(broken, *each)


# ---- the typed graph


def observations(d: Documents) -> DataFrame:
    """(graph_id, id, kind, name, native, quantity, presence, value): every property of the catalogue for every node of its kind, there or not.

    value is a union: the field of its native type is set (text, number, flag, or items of these where the quantity is many).
    """
    there = d.nodes.select("graph_id", "id", "kind", "properties")
    rows = there.join(F.broadcast(d.catalogue), "kind").withColumn("v", F.try_element_at("properties", F.col("name")))
    absent = F.when(F.col("quantity") == "one", "missing_required").when(F.col("quantity") == "optional", "absent_optional").otherwise("absent_many")
    one = F.col("quantity") != "many"
    get = lambda native, kind: F.when(F.col("native") == native, F.try_variant_get("v", "$", kind))
    value = F.struct(
        *(F.when(one, get(native, kind)).alias(n) for n, native, kind in (("text", "str", "string"), ("number", "int", "int"), ("flag", "bool", "boolean"))),
        *(F.when(~one, get(native, f"array<{kind}>")).alias(n) for n, native, kind in (("texts", "str", "string"), ("numbers", "int", "int"), ("flags", "bool", "boolean"))),
    )
    return rows.select("graph_id", "id", "kind", "name", "native", "quantity", F.when(F.col("v").isNotNull(), "present").otherwise(absent).alias("presence"), F.when(F.col("v").isNotNull(), value).alias("value"))


def _owners(m: Column) -> Column:
    """For each node its nearest method or none, by pointers that double within the row; own_at is where it is among the names, m of `_with_ups`."""
    up = lambda i: F.get(F.get("src_at", F.get(m["ups"], F.get("own_at", i))["edge"]), F.lit(0))
    method = lambda x: F.coalesce(x["kind"] == "METHOD", F.lit(False))
    start = F.transform("nodes", lambda x, i: F.struct(F.when(method(x), x["id"]).alias("owner"), F.when(~method(x), up(i)).alias("up")))
    above = lambda acc, x: F.get(acc, x["up"])
    step = lambda acc, x: F.struct(F.coalesce(x["owner"], above(acc, x)["owner"]).alias("owner"), F.when(above(acc, x)["owner"].isNull(), above(acc, x)["up"]).alias("up"))
    open_ = lambda x: x["up"].isNotNull()
    found = lambda tops: F.when(F.exists(tops, open_), F.raise_error(F.lit("the parents form a cycle")).cast("array<string>")).otherwise(tops["owner"])
    return _let(start, lambda x: _let(_doubled(x, F.size("nodes"), step, open_), found))


def _roles(edge: Column, a: Column, b: Column) -> Column:
    """The roles that an edge of this kind between nodes of these kinds plays for the first."""
    parts = F.create_map(*(F.lit(x) for kv in zip(METHOD_PARTS, ("inputs", "outputs", "returns", "modifiers"), strict=True) for x in kv))
    call = F.when(edge == "CALL", "callees").when(edge == "RECEIVER", "receivers").when(edge == "ARGUMENT", "arguments")
    back = F.when(edge == "ARGUMENT", "arguments").when((edge == "CFG") & (b == "METHOD_RETURN"), "exits")
    own = F.when((a == "METHOD") & (edge == "AST"), F.try_element_at(parts, b)).when(a == "CALL", call).when(a == "RETURN", back).when(a.isin(*FORMALS) & (edge == "PARAMETER_LINK"), "links")
    return F.array_compact(F.array(own, F.when(edge.isin(*RELATIONS), edge)))


def owned_views(d: Documents) -> DataFrame:
    """(graph_id, node, role, owner, ordinals): the edges that play a role for a node, in the order of the document, and the method that owns the node.

    A method has its children by kind (`inputs`, `outputs`, `returns`, `modifiers`), a call `callees`, `receivers` and `arguments`, a
    formal its `links` (those that leave it first), a return its `arguments` and `exits`, and any node its relations by edge kind.
    """
    linked = F.transform("edges", lambda e: F.when(e["kind"] == "PARAMETER_LINK", e["dst"]))
    rows = _met(d).withColumns({"own_at": _at("names", "nodes.id"), "out": _all_at("edges.src", "nodes.id"), "linked": _all_at(linked, "nodes.id")})
    kind = lambda places: F.get("nodes", F.get(places, F.lit(0)))["kind"]
    there = lambda e, i: e["src"].isNotNull() & e["dst"].isNotNull() & F.get("src_at", i).isNotNull() & F.get("dst_at", i).isNotNull()
    roles = F.transform("edges", lambda e, i: F.when(there(e, i), _roles(e["kind"], kind(F.get("src_at", i)), kind(F.get("dst_at", i)))).otherwise(F.array().cast("array<string>")))
    role = lambda r, e: F.struct(r.alias("role"), e.cast("long").alias("ordinal"))
    leaving = lambda i, roles: F.flatten(F.transform(F.get("out", i), lambda e: F.transform(F.get(roles, e), lambda r: role(r, e))))
    arriving = lambda x, i: F.transform(F.filter(F.when(x["kind"].isin(*FORMALS), F.get("linked", i)), lambda e: F.get("src_at", e).isNotNull()), lambda e: role(F.lit("links"), e))
    never = F.array().cast("array<struct<role:string,ordinal:bigint>>")
    played = lambda x, i, roles: F.when(x["id"].isNotNull(), F.concat(F.coalesce(leaving(i, roles), never), F.coalesce(arriving(x, i), never))).otherwise(never)
    each = lambda x, owner, rs: F.transform(F.array_distinct(rs["role"]), lambda r: F.struct(x["id"].alias("node"), r.alias("role"), owner.alias("owner"), F.filter(rs, lambda p: p["role"] == r)["ordinal"].alias("ordinals")))
    views = lambda owners, roles: F.flatten(F.transform("nodes", lambda x, i: _let(played(x, i, roles), lambda rs: each(x, F.get(owners, i), rs))))
    every = _with_ups(lambda m: _let(_owners(m), lambda owners: _let(roles, lambda r: views(owners, r))))
    return rows.select("graph_id", F.explode(every).alias("x")).select("graph_id", "x.*")


def role_edges(d: Documents) -> DataFrame:
    """(graph_id, node, role, place, ordinal): `owned_views` as rows."""
    return owned_views(d).select("graph_id", "node", "role", F.posexplode("ordinals").alias("place", "ordinal")).withColumn("place", F.col("place").cast("long"))


def views(d: Documents) -> DataFrame:
    """(graph_id, node, role, ordinals): the edges by role for each node."""
    return owned_views(d).drop("owner")


def ownership(d: Documents) -> DataFrame:
    """(graph_id, node, owner, status): the nearest method at or above each node, or none; for documents without cyclic ownership."""
    nodes = lambda owners: F.transform("nodes", lambda x, i: F.struct(x["id"].alias("node"), F.get(owners, i).alias("owner")))
    rows = _met(d).withColumn("own_at", _at("names", "nodes.id"))
    out = rows.select("graph_id", F.explode(_with_ups(lambda m: _let(_owners(m), nodes))).alias("x")).select("graph_id", "x.*")
    return out.withColumn("status", F.when(F.col("owner").isNotNull(), "observed").otherwise("no_method_ancestor"))


def methods_by_full_name(d: Documents, names: DataFrame) -> DataFrame:
    """names (graph_id, full_name, ...) with `candidates`: all methods of exactly this name, in the order of the document; none is chosen."""
    full = F.try_variant_get(F.try_element_at("properties", F.lit("FULL_NAME")), "$", "string")
    found = d.nodes.where("kind = 'METHOD'").select("graph_id", full.alias("full_name"), F.struct("ordinal", "id").alias("m"))
    return _candidates(names, found, ["graph_id", "full_name"])


def methods_at_source(d: Documents, hints: DataFrame) -> DataFrame:
    """hints (graph_id, filename, line, ...) with `candidates`: all methods that stand exactly there; no path is normalised."""
    get = lambda n, kind: F.try_variant_get(F.try_element_at("properties", F.lit(n)), "$", kind)
    found = d.nodes.where("kind = 'METHOD'").select("graph_id", get("FILENAME", "string").alias("filename"), get("LINE_NUMBER", "int").alias("line"), F.struct("ordinal", "id").alias("m"))
    return _candidates(hints, found, ["graph_id", "filename", "line"])


def _candidates(asked: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    groups = found.dropna(subset=keys).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["id"]).alias("candidates"))
    return asked.join(groups, keys, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
