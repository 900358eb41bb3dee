"""Entity resolution: extraction records to a graph whose every row names the chunk it came from.

records: chunk, status, extraction<entities array<name,type,description,aliases>, relations
array<source,target,relation,evidence>>. All steps are joins, windows and aggregates; only name folding is a UDF.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomstack.functions.text import casefold, document_of, mergeable, name_key, slug, snake, stripped
from loomstack.operators import repair
from loomstack.operators.graph import components
from loomstack.shared import written

# The kinds of entity, from the most concrete to the least; a tie goes to the earlier one.
ENTITY_TYPES = ("organisation", "person", "board", "mission", "spacecraft", "subsystem", "software", "facility", "document", "event", "cause", "recommendation", "other")
DESCRIPTION_CHARS = 300


def _trimmed(c: Column) -> Column:
    return F.coalesce(stripped(c), F.lit(""))


def usable(records: DataFrame) -> DataFrame:
    """Records that count: all but failed ones; no status is a good one."""
    return records.filter(F.coalesce("status", F.lit("ok")) != "failed")


@F.pandas_udf(ArrayType(StringType()))
def _same(fold: pd.Series, names: pd.Series) -> pd.Series:
    """Of a list of names those that are the folded one, case aside."""
    return pd.Series([[n for n in own if n is not None and n.casefold() == f] for f, own in zip(fold, names, strict=True)])


def repaired_entities(records: DataFrame) -> DataFrame:
    """chunk, pos, name, type, description, aliases, fold, fault: one row per listed entity; fault is null for those kept.

    Faults: dropped (no name), duplicate (the name, case aside, came before in the chunk). An unknown type becomes
    `other` and sets retyped.
    """
    listed = usable(records).select("chunk", F.posexplode("extraction.entities").alias("pos", "e"))
    named = listed.select(
        "chunk", "pos", _trimmed(F.col("e.name")).alias("name"), casefold(_trimmed(F.col("e.type"))).alias("kind"),
        _trimmed(F.col("e.description")).alias("description"), F.coalesce(F.col("e.aliases"), F.array().cast("array<string>")).alias("raw"),
    ).withColumn("fold", casefold("name")).withColumn("same", _same(F.col("fold"), F.transform("raw", stripped)))
    nth = F.row_number().over(Window.partitionBy("chunk", "fold").orderBy("pos"))
    known = F.col("kind").isin(*ENTITY_TYPES)
    fault = F.when(F.col("name") == "", "dropped").when(nth > 1, "duplicate")
    aliases = F.array_sort(F.array_distinct(F.filter(F.transform("raw", stripped), lambda a: a.isNotNull() & (a != "") & ~F.array_contains("same", a))))
    return named.withColumn("fault", fault).select(
        "chunk", "pos", "name", "fold", "description", F.when(known, F.col("kind")).otherwise("other").alias("type"), aliases.alias("aliases"), (~known & F.col("fault").isNull()).alias("retyped"), "fault",
    )


def repaired_relations(records: DataFrame, entities: DataFrame) -> DataFrame:
    """chunk, pos, source, target, relation, evidence, fault: endpoints in the casing that the chunk's entities have."""
    declared = entities.filter("fault IS NULL").select("chunk", "fold", "name")
    listed = usable(records).select("chunk", F.posexplode("extraction.relations").alias("pos", "r"))
    listed = listed.select("chunk", "pos", casefold(_trimmed(F.col("r.source"))).alias("s"), casefold(_trimmed(F.col("r.target"))).alias("t"), snake(F.coalesce("r.relation", F.lit(""))).alias("relation"), _trimmed(F.col("r.evidence")).alias("evidence"))
    ends = listed.join(declared.select("chunk", F.col("fold").alias("s"), F.col("name").alias("source")), ["chunk", "s"], "left").join(
        declared.select("chunk", F.col("fold").alias("t"), F.col("name").alias("target")), ["chunk", "t"], "left"
    )
    fine = F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")) & (F.col("relation") != "")
    return ends.select("chunk", "pos", "source", "target", "relation", "evidence", F.when(~fine, "dropped").alias("fault"))


def mentions(entities: DataFrame) -> DataFrame:
    """chunk, name, key, type, description, aliases of kept entities whose key is not empty."""
    return entities.filter("fault IS NULL").withColumn("key", name_key("name")).filter("key <> ''").select("chunk", "name", "key", "type", "description", "aliases")


def alias_pairs(found: DataFrame) -> DataFrame:
    """a, b: keys that an alias ties together; both must be specific enough."""
    pairs = found.filter(mergeable(F.col("key"))).select(F.col("key").alias("a"), F.explode("aliases").alias("alias"))
    pairs = pairs.withColumn("b", name_key("alias"))
    return pairs.filter((F.col("b") != "") & (F.col("a") != F.col("b")) & mergeable(F.col("b"))).select("a", "b").distinct()


def modal(rows: DataFrame, group: str, value: str, *ties: Column, weight: str | None = None) -> DataFrame:
    """group, value: the most frequent value of each group; ties by the given order. weight: how often each row counts."""
    counts = rows.groupBy(group, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), *ties))
    return counts.withColumn("_n", nth).filter("_n = 1").select(group, value)


def _longest(rows: DataFrame, group: str) -> DataFrame:
    own = rows.filter("description <> ''").groupBy(group).agg(F.min(F.struct((-F.length("description")).alias("n"), "description")).alias("d"))
    return own.select(group, "d.description")


def longest_description(rows: DataFrame, group: str) -> DataFrame:
    """group, description: the longest, the alphabet breaking ties, cut and trimmed; null without any."""
    return _longest(rows, group).withColumn("description", F.trim(F.substring("description", 1, DESCRIPTION_CHARS)))


def unique_ids(groups: DataFrame, root: str = "root", name: str = "name") -> DataFrame:
    """root, node_id: slugs of names; of equal slugs the first by root keeps it, the next get -2, -3 and so on.

    A numbered id that another group's slug already is goes on to the next free number.
    """
    nth = F.row_number().over(Window.partitionBy("slug").orderBy(root))
    own = groups.select(root, slug(name).alias("slug")).withColumn("n", nth)
    numbered = own.withColumn("node_id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n")))
    while True:
        place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.col("n") > 1, root))
        clash = written(numbered.withColumn("place", place), "ids")
        if clash.filter("place > 1").isEmpty():
            return clash.select(root, "node_id")
        most = clash.groupBy("slug").agg(F.max("n").alias("most"))
        again = F.row_number().over(Window.partitionBy("slug").orderBy(F.col("place") == 1, "n"))
        numbered = clash.join(most, "slug").withColumn("n", F.when(F.col("place") > 1, F.col("most") + again).otherwise(F.col("n"))).select(root, "slug", "n")
        numbered = numbered.withColumn("node_id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n")))


def edge_id(*parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


@dataclass
class Graph:
    nodes: DataFrame  # id, name, type, description, mentions
    edges: DataFrame  # id, source, target, relation, chunk_id, evidence
    node_chunks: DataFrame  # node_id, chunk_id
    aliases: DataFrame  # node_id, alias: other names that the node goes by
    dropped: DataFrame  # reason, n
    kinds: DataFrame  # id, type: nodes without what takes more to work out


def whole(records: DataFrame) -> DataFrame:
    """chunk, extraction of all usable records, one for each chunk: only those of a chunk that several share are gathered."""
    own = usable(records).select("chunk", "extraction")
    again = written(own.groupBy(F.col("chunk").alias("c")).agg(F.count("*").alias("n")).filter("n > 1").select("c"), "shared-chunks")
    if not again.isEmpty():
        shared = own.join(again, F.col("chunk").eqNullSafe(F.col("c")), "left_semi").groupBy("chunk").agg(
            F.struct(*(F.flatten(F.collect_list(f"extraction.{part}")).alias(part) for part in ("entities", "relations"))).alias("extraction")
        )
        own = own.join(again, F.col("chunk").eqNullSafe(F.col("c")), "left_anti").unionByName(shared)
    return own


def kept(records: DataFrame) -> DataFrame:
    """What repair.KEPT names, of all usable records: mentions with a key and relations between declared names.

    Records are repaired where they are.
    """
    return whole(records).mapInArrow(repair.repaired(ENTITY_TYPES), repair.KEPT)


def keyed(own: DataFrame, ids: DataFrame) -> DataFrame:
    """key, node_id, alone of mentions with their root: whether no other key has the node."""
    keys = own.select("key", "root").distinct()
    alone = keys.groupBy("root").agg((F.count("*") == 1).alias("alone"))
    return written(keys.join(ids.join(alone, "root"), "root").select("key", "node_id", "alone"), "keys")


def node_chunks(records: DataFrame) -> DataFrame:
    """build(records).node_chunks from names and aliases alone.

    A key's mentions in a chunk meet where they are repaired, so only nodes of several keys are dealt by chunk.
    """
    lists = whole(records).select("chunk", F.col("extraction.entities.name").alias("names"), F.col("extraction.entities.aliases").alias("aliases"))
    rows = written(lists.mapInArrow(repair.mentioned, repair.MENTIONED), "mentioned")
    said = written(rows.groupBy("key", "name", "ties").agg(F.count("*").alias("times")), "said")
    tied = said.filter(mergeable(F.col("key")) & (F.col("ties") != "")).select(F.col("key").alias("a"), F.explode(F.split("ties", "\n")).alias("b"))
    roots = components(said.select("key").distinct(), written(tied.filter(mergeable(F.col("b"))).distinct(), "ties"))
    own = written(said.groupBy("key", "name").agg(F.sum("times").alias("times")).join(roots, "key"), "mentions")
    by_key = keyed(own, unique_ids(written(modal(own, "root", "name", F.col("name"), weight="times"), "names")))
    placed = lambda keys: rows.filter("NOT again").select("key", F.col("chunk").alias("chunk_id")).join(keys.select("key", "node_id").hint("shuffle_hash"), "key").select("node_id", "chunk_id")
    return placed(by_key.filter("alone")).unionByName(placed(by_key.filter("NOT alone")).repartition("chunk_id").distinct())


def build(records: DataFrame) -> Graph:
    """The graph of extraction records.

    Repaired records are written once. Mentions that are alike become one row with their number before anything is
    resolved, so components, names and ids are worked out on the different ones alone.
    """
    rows = written(kept(records), "repaired")
    found, relations = rows.filter("key IS NOT NULL"), rows.filter("source IS NOT NULL").select(F.col("source").alias("s"), F.col("target").alias("t"), "relation", "chunk", "evidence")
    said = written(found.groupBy("key", "name", "type", "aliases").agg(F.count("*").alias("times")), "said")
    own = written(said.join(components(said.select("key").distinct(), alias_pairs(said)), "key"), "mentions")
    names = written(modal(own, "root", "name", F.col("name"), weight="times"), "names")
    types = modal(own, "root", "type", F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), F.col("type")), weight="times")
    ids = unique_ids(names)
    by_key = written(own.select("key", "root").distinct().join(ids, "root").select("key", "node_id"), "keys")
    kinds = ids.join(types, "root").select("root", F.col("node_id").alias("id"), "type")
    described = longest_description(_longest(found, "key").join(own.select("key", "root").distinct(), "key"), "root")
    nodes = kinds.join(names, "root").join(described, "root", "left").join(own.groupBy("root").agg(F.sum("times").alias("mentions")), "root").select("id", "name", "type", "description", "mentions")
    surfaces = own.select("root", F.explode(F.array_append("aliases", F.col("name"))).alias("alias")).distinct()
    aliases = surfaces.join(names, "root").filter("alias <> name").join(ids, "root").select("node_id", "alias")
    # keys are few beside what they are joined with and stand in one row each: hashed, not sorted
    ends = relations
    for end, side in (("s", "source"), ("t", "target")):
        ends = ends.join(by_key.select(F.col("key").alias(end), F.col("node_id").alias(side)).hint("shuffle_hash"), end, "left")
    ends = ends.withColumn("reason", F.when(F.col("source").isNull() | F.col("target").isNull(), "no_node").when(F.col("source") == F.col("target"), "same_node"))
    # dealt by chunk first, so that equal edges meet by one sort and equal pairs by none
    edges = ends.filter("reason IS NULL").repartition("chunk").groupBy("source", "target", "relation", F.col("chunk").alias("chunk_id")).agg(F.min("evidence").alias("evidence"))
    edges = edges.select(edge_id("source", "target", "relation", "chunk_id").alias("id"), "source", "target", "relation", "chunk_id", "evidence")
    node_chunks = found.select("key", "chunk").join(by_key.hint("shuffle_hash"), "key").select("node_id", F.col("chunk").alias("chunk_id")).repartition("chunk_id").distinct()
    return Graph(nodes, edges, node_chunks, aliases, ends.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")), kinds.select("id", "type"))


def sorted_set(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """group, name: the group's distinct values in order, as an array; all of a group are in one row."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(value)).alias(name))


def node_records(graph: Graph) -> DataFrame:
    """Nodes with their sorted aliases, documents and chunks as arrays, for reports: one row holds all of a node.

    build() itself keeps these as rows, so a node that stands in most chunks is no row that outgrows a task.
    """
    placed = graph.node_chunks.select(F.col("node_id").alias("id"), "chunk_id", document_of(F.col("chunk_id")).alias("document"))
    sets = sorted_set(placed, "id", "chunk_id", "chunks").join(sorted_set(placed, "id", "document", "documents"), "id")
    other = sorted_set(graph.aliases.withColumnRenamed("node_id", "id"), "id", "alias", "aliases")
    return graph.nodes.join(sets, "id", "left").join(other, "id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "documents", "chunks")})


def node_counts(graph: Graph) -> DataFrame:
    """Nodes with the number of their chunks and their sorted documents and aliases: no row holds a node's chunks."""
    placed = graph.node_chunks.groupBy(F.col("node_id").alias("id"), document_of(F.col("chunk_id")).alias("document")).agg(F.count("chunk_id").alias("n"))
    sets = placed.groupBy("id").agg(F.sum("n").alias("chunks"), F.array_sort(F.collect_set("document")).alias("documents"))
    other = sorted_set(graph.aliases.withColumnRenamed("node_id", "id"), "id", "alias", "aliases")
    return graph.nodes.join(sets, "id", "left").join(other, "id", "left").withColumns({"chunks": F.coalesce("chunks", F.lit(0))} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "documents")})


def provenance(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """edges with the text of the chunk (id, text) that each came from; an edge whose chunk is not there falls away."""
    return edges.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")


def types_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def record_counts(records: DataFrame) -> DataFrame:
    """status, n of all records; those without a status count as ok."""
    return records.groupBy(F.coalesce("status", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"))
