"""How the star schema stands in for a corpus: graph, chunks, questions. Every rule is plain arithmetic on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_chunk():
    """The chunk of an order line: year of shipping, a colon, the order."""
    return F.format_string("%d:%d", F.year("l_shipdate"), "l_orderkey")


ORDER_CHUNK = "year(l_shipdate) || ':' || l_orderkey"


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (part), target (supplier), relation, chunk_id of every order line."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(F.format_string("p%d", "l_partkey").alias("source"), F.format_string("s%d", "l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), order_chunk().alias("chunk_id"))


EDGES = f"SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_returnflag AS relation, {ORDER_CHUNK} AS chunk_id FROM lineitem"


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: the chunks of order lines, with their order's priority as text."""
    chunks = load(spark, sf_dir, "lineitem").select(order_chunk().alias("id"), F.col("l_orderkey").alias("o_orderkey")).distinct()
    return chunks.join(load(spark, sf_dir, "orders"), "o_orderkey").select("id", F.col("o_orderpriority").alias("text"))


def order_node_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.explode(F.array("source", "target")).alias("node_id")
    return order_edges(spark, sf_dir).select(ends, "chunk_id").distinct()


NODE_CHUNKS = f"SELECT source AS node_id, chunk_id FROM ({EDGES}) UNION SELECT target, chunk_id FROM ({EDGES})"


def order_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, chunk_id: the chunks of orders whose key leaves 11 * qid when divided by 4999, qid up to 4."""
    lines = load(spark, sf_dir, "lineitem").filter((F.pmod("l_orderkey", F.lit(4999)) % 11 == 0) & (F.pmod("l_orderkey", F.lit(4999)) <= 44))
    return lines.select((F.pmod("l_orderkey", F.lit(4999)) / 11).cast("int").alias("qid"), order_chunk().alias("chunk_id")).distinct()


SEEDS = f"SELECT DISTINCT ((l_orderkey % 4999) // 11)::INT AS qid, {ORDER_CHUNK} AS chunk_id FROM lineitem WHERE (l_orderkey % 4999) % 11 = 0 AND l_orderkey % 4999 <= 44"


def path_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, node_chunks and seeds of a path through the nations by key, a chunk for each, seeds at 0 and 12."""
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    edges = nations.filter("n < 24").select(F.format_string("n%d", "n").alias("source"), F.format_string("n%d", F.col("n") + 1).alias("target"))
    chunks = nations.select(F.format_string("n%d", "n").alias("node_id"), F.format_string("c:%d", "n").alias("chunk_id"))
    return edges, chunks, nations.filter("n IN (0, 12)").select((F.col("n") / 12).cast("int").alias("qid"), F.format_string("c:%d", "n").alias("chunk_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.format_string("v%05d", "vec_id").alias("id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return load(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def vector_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, edges, node_chunks over the vectors: entities m0 to m36 by vec_id modulo 37, tied to five times their number."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.format_string("v%05d", "vec_id").alias("id"))
    m = F.pmod("vec_id", F.lit(37))
    chunks = rows.select("id", F.format_string("label%d", "label").alias("document"), m.cast("int").alias("page_start"), (m + 1).cast("int").alias("page_end"), F.concat(F.lit("text "), "id").alias("text"))
    edges = rows.select(F.format_string("m%d", m).alias("source"), F.format_string("m%d", F.pmod(m * 5, F.lit(37))).alias("target"), F.lit("next").alias("relation"), F.col("id").alias("chunk_id"))
    return chunks, edges, rows.select(F.format_string("m%d", m).alias("node_id"), F.col("id").alias("chunk_id"))


#: (qid, rank, id, score) of every query against all vectors, as a CTE body.
RANKED = """
SELECT q.vec_id AS qid, 'v' || lpad(e.vec_id::VARCHAR, 5, '0') AS id, e.vec_id, e.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"""


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document, page, text: conversations as documents, turns as pages from 1."""
    return load(spark, sf_dir, "conversations").select(F.format_string("conv%d", "conv_id").alias("document"), (F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


PAGES = "SELECT 'conv' || conv_id AS document, (turn + 1)::INT AS page, coalesce(text, '') AS text FROM conversations"


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document and whole text with a mark before each page."""
    pages = conversation_pages(spark, sf_dir).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return pages.select("document", F.concat_ws("", F.transform("p", lambda p: F.format_string("\f--- page %d ---\n%s\n", p["page"], p["text"]))).alias("text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records, one for each order: its lines' parts and suppliers, with planted faults."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    entity = lambda name, kind, text, *aliases: F.struct(name.alias("name"), kind.alias("type"), text.alias("description"), F.array(*aliases).alias("aliases"))

    def entities(line):
        part, supplier = (F.concat(F.lit(word), number(line[key])) for word, key in (("Part ", "l_partkey"), ("Supplier ", "l_suppkey")))
        kind = F.when(line["l_linenumber"] == 2, "Alien").otherwise("Spacecraft")
        text = F.concat(F.lit("a part of order "), number(F.col("l_orderkey")))
        house = F.concat(F.lit("House "), number(F.pmod(line["l_suppkey"], F.lit(40))))
        return F.array(entity(part, kind, text, F.upper(part), F.concat(F.lit("P-"), number(line["l_partkey"]))), entity(supplier, F.lit("organisation"), F.lit(""), house))

    def relation(line):
        said = F.when(line["l_returnflag"] == "R", "Sent Back to").otherwise("made by")
        return F.struct(F.concat(F.lit("part "), number(line["l_partkey"])).alias("source"), F.concat(F.lit("Supplier "), number(line["l_suppkey"])).alias("target"), said.alias("relation"), F.lit("the line").alias("evidence"))

    # order lines are gathered as numbers; their texts are made where they are gathered
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("lines"))
    row = lines.select("l_orderkey", F.flatten(F.transform("lines", entities)).alias("entities"), F.transform("lines", relation).alias("relations"))
    return row.select(F.concat(F.lit("o"), number(F.pmod("l_orderkey", F.lit(9))), F.lit(":"), number(F.col("l_orderkey"))).alias("chunk"), F.when(F.col("l_orderkey") % 35 == 0, "failed").when(F.col("l_orderkey") % 2 == 0, "ok").alias("status"), F.struct("entities", "relations").alias("extraction"))


RECORD_LINES = "SELECT *, 'o' || (l_orderkey % 9) || ':' || l_orderkey AS chunk FROM lineitem WHERE l_orderkey % 35 <> 0"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each benchmark item, with one gold passage, some of them faulty by rule."""
    items = load(spark, sf_dir, "benchmark")
    gold = F.struct(F.lit("bench").alias("doc"), F.col("item_id").cast("int").alias("page"), F.when(F.col("item_id") % 6 == 5, "clue").otherwise("answer").alias("role"), F.col("text").alias("quote"))
    return items.select(
        F.format_string("q%d", "item_id").alias("id"), F.when(F.col("item_id") % 4 == 3, "multi-hop").otherwise("single-hop").alias("kind"), F.when(F.col("item_id") % 10 == 9, " ").otherwise("what?").alias("question"),
        F.lit("that").alias("answer"), F.lit(None).cast("string").alias("hops"), F.array(gold).alias("gold"),
    )
