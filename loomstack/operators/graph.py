"""Graph operators: bounded undirected walks for many queries at once, components, degrees.

edges(source, target, ...), node_chunks(node_id, chunk_id), seeds(qid, chunk_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstack.shared import discard, written

HOPS, WALK_LIMIT = 2, 20
#: A key that more than one in HOT rows have is met by a broadcast, so at most HOT keys are; all others by a shuffle.
HOT = 1 << 14


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours both ways, once."""
    pairs = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b"))))
    return edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).select(pairs.alias("p")).select("p.a", "p.b").distinct()


def reach(edges: DataFrame, node_chunks: DataFrame, seeds: DataFrame, hops: int = HOPS, through: int | None = None) -> DataFrame:
    """qid, node_id, hop: nodes within hops of the seeds' nodes and the fewest hops to them.

    through: nodes with more neighbours than this are reached, but the walk does not go on from them (off by default).

    Each hop joins only the nodes new in the last one and drops what was reached before, so a hub multiplies
    no paths. Frontiers and neighbours are written once, so no hop works out the hops before it anew.
    """
    frontier = written(seeds.join(node_chunks, "chunk_id").select("qid", "node_id").distinct().withColumn("hop", F.lit(0)), "frontier")
    reached = frontier
    if hops:
        ways = both = written(undirected(edges), "neighbours")
        if through is not None:
            ways = both.join(both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") <= through).select("a"), "a", "left_semi")
    for hop in range(1, hops + 1):
        step = frontier.select("qid", F.col("node_id").alias("a")).join(ways, "a").select("qid", F.col("b").alias("node_id")).distinct()
        frontier = written(step.join(reached.select("qid", "node_id"), ["qid", "node_id"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def foremost(node_chunks: DataFrame, n: int) -> DataFrame:
    """node_id, chunk_id, each pair once, of the first n chunks by id among those that have exactly the same nodes.

    Any walk reaches such chunks at the same hop and by as many nodes, so their ids alone order them: the others stand
    behind n of their like for every query. So a node that stands in most chunks is not met by all of them.
    """
    alike = node_chunks.groupBy("chunk_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    nth = F.row_number().over(Window.partitionBy("nodes").orderBy("chunk_id"))
    return alike.withColumn("_n", nth).filter(F.col("_n") <= n).select(F.explode("nodes").alias("node_id"), "chunk_id")


def walk(edges: DataFrame, node_chunks: DataFrame, seeds: DataFrame, hops: int = HOPS, limit: int = WALK_LIMIT, per_hop: int | None = None, through: int | None = None) -> DataFrame:
    """qid, pos, chunk_id, min_hop, node_count: chunks of reached nodes, nearest first, then most nodes, then id.

    per_hop: at most so many chunks of each hop, so near ones cannot crowd out far ones; through: as reach() takes it (both off by default).
    """
    found = reach(edges, node_chunks, seeds, hops, through).join(foremost(node_chunks, limit), "node_id")
    chunks = found.groupBy("qid", "chunk_id").agg(F.min("hop").alias("min_hop"), F.count("*").alias("node_count"))
    order: list[Column] = [F.col("min_hop"), F.desc("node_count"), F.col("chunk_id")]
    if per_hop is not None:
        chunks = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "min_hop").orderBy(*order[1:]))).filter(F.col("_n") <= per_hop).drop("_n")
    return chunks.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("pos") <= limit).select("qid", "pos", "chunk_id", "min_hop", "node_count")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree; nodes without an edge have 0. A self-loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def top_degrees(nodes: DataFrame, edges: DataFrame, n: int = 15) -> DataFrame:
    return degrees(nodes, edges).filter("degree > 0").orderBy(F.desc("degree"), "node_id").limit(n)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    return nodes.select("node_id").join(ends, "node_id", "left_anti")


def ranked_counts(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n, place: how often each value stands in each group, the most frequent first, ties by value."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value)))


def cross_document(node_chunks: DataFrame, document: Column) -> DataFrame:
    """node_id, documents: nodes whose chunks lie in more than one document."""
    return node_chunks.groupBy("node_id").agg(F.countDistinct(document).alias("documents")).filter("documents > 1")


def met(rows: DataFrame, values: DataFrame, key: str, value: str, n: str, total: int) -> DataFrame:
    """rows with the value of their key from values (key, value, n: rows of that key), an inner join.

    Hot keys are met by a broadcast of at most HOT rows, so no task gets all rows of one; the rest by a shuffle.
    """
    hot = F.broadcast(values.filter(F.col(n) * HOT > total).select(key, F.col(value).alias("_hot"), F.lit(True).alias("_is_hot")))
    tried = rows.join(hot, key, "left")
    near = tried.filter("_is_hot").select(*rows.columns, F.col("_hot").alias(value))
    rest = tried.filter("_is_hot IS NULL").select(*rows.columns).join(values.select(key, value), key)
    return near.unionByName(rest.select(near.columns))


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of edges u > v: each node u with the least node v of its component, v itself left out.

    Rounds of a large star (every greater neighbour of u hangs on the least node around u) and a small star (the
    lesser ones do), until nothing changes. Neighbours meet only in a minimum and in met(), so a hub needs neither a
    list of its neighbours nor a task of its own.
    """
    edges, seen = written(edges.distinct(), "stars"), None
    while True:  # each round reads only what the one before wrote
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges
        seen, total = now, 2 * now["n"]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
        large = written(met(both.filter("v > u"), least, "u", "m", "k", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        down = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = met(large, least, "u", "m", "k", total).select(down.alias("e")).select("e.u", "e.v")
        last, edges = edges, written(small.filter("u > v").distinct(), "stars")
        discard(last)
        discard(large)


def components(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, root: the least key that undirected pairs (a, b) connect to each key of vertices and pairs."""
    links = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tied = stars(links)
    roots = tied.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(tied.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
    return roots.unionByName(vertices.select("key").union(pairs.filter("a = b").select("a")).distinct().join(roots.select("key"), "key", "left_anti").select("key", F.col("key").alias("root")))
