"""Scoring of ranked hits against gold passages, coverage of passages by chunks, and question validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomstack.functions.runs import Runs
from loomstack.functions.text import contains_half, held, overlaps, span_on_page, spaced

CUTS = (5, 10)
#: Bytes of quotes that are sent to all tasks at once.
BLOCK_BYTES = 4 << 20
#: The same, where a task holds all stretches of the quotes; and most quotes and rows that go with them.
RUN_BYTES, RUN_QUOTES, RUN_ROWS = 256 << 10, 512, 1 << 16
KINDS, ROLES = ("single-hop", "multi-hop"), ("answer", "bridge")
QUOTE_CHARS = (80, 400)
#: Errors that tell of a source that is not there or not well formed.
UNREADABLE = ("PATH_NOT_FOUND", "MALFORMED_RECORD", "FAILED_READ_FILE")


def met(hits: DataFrame, quotes: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """quotes (qid, quote, ...) with the _rank of every hit that holds half of them.

    hits: (qid, rank, text), each met by the quotes of its query; or (rank, text), each met by all quotes. These are
    then a stated set, sent to all tasks in blocks of at most block_bytes; no pair is formed that shares nothing.
    """
    if "qid" in hits.columns:
        return quotes.join(hits.select("qid", F.col("rank").alias("_rank"), "text"), "qid").filter(contains_half(F.col("text"), F.col("quote"))).drop("text")
    rows = hits.select(spaced(F.col("text")).alias("_text"), F.col("rank").alias("_rank")).filter(F.col("_text") != "")
    kind = StructType([*quotes.schema.fields, StructField("_rank", hits.schema["rank"].dataType)])
    found = [rows.mapInArrow(_holders(hits.sparkSession.sparkContext.broadcast(block), to_arrow_schema(kind)), kind) for block in _blocks(quotes, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else hits.sparkSession.createDataFrame([], kind)


def _blocks(quotes: DataFrame, block_bytes: int, most: int | None = None, empty: bool = False) -> Iterator[list[tuple[str, tuple]]]:
    """Settled quotes with their rows, as they stream to the driver, in blocks of at most block_bytes and `most` quotes; empty: null and empty ones too."""
    block, size = [], 0
    settled = quotes.withColumn("_quote", F.coalesce(spaced(F.col("quote")), F.lit("")))
    for r in (settled if empty else settled.filter(F.col("_quote") != "")).toLocalIterator():
        if block and (size + 4 * len(r["_quote"]) > block_bytes or len(block) == most):
            yield block
            block, size = [], 0
        block.append((r["_quote"], tuple(r)[:-1]))
        size += 4 * len(r["_quote"])
    if block:
        yield block


def _holders(sent: Broadcast, kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map from texts (_text, _rank) to the quotes that they hold half of.

    Half of a quote, wherever it lies, covers one of its consecutive parts of a quarter whole, as in contains_half(). One
    pass over a text finds the parts of all quotes in it, and only those quotes are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        parts: dict[str, list[int]] = {}
        for n, (quote, _) in enumerate(sent.value):
            wide = max(((len(quote) + 1) // 2 + 1) // 2, 1)
            for at in range(0, len(quote) - wide + 1, wide):
                parts.setdefault(quote[at : at + wide], []).append(n)
        search = ahocorasick.Automaton()
        for part, own in parts.items():
            search.add_word(part, tuple(set(own)))
        search.make_automaton()
        for batch in batches:
            out = []
            for text, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n in {n for _, own in search.iter(text) for n in own}:
                    quote, row = sent.value[n]
                    half = (len(quote) + 1) // 2
                    if quote in text or any(quote[i : i + half] in text for i in range(len(quote) - half + 1)):
                        out.append((*row, rank))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kind), kind.types, strict=True)], schema=kind)

    return run


def runs(texts: DataFrame, quotes: DataFrame, block_bytes: int = RUN_BYTES) -> DataFrame:
    """For every quote (qid, quote) and every text (text, other columns): qid, the other columns, run and held.

    run: characters of the longest stretch that they share, white space aside; held: its share of the quote. Null and empty
    ones share nothing. The quotes are a stated set, sent to all tasks in blocks; one pass over a text serves a whole block.
    """
    others = [c for c in texts.columns if c != "text"]
    rows = texts.select(*others, F.coalesce(spaced(F.col("text")), F.lit("")).alias("text"))
    kind = StructType([quotes.schema["qid"], *(texts.schema[c] for c in others), StructField("run", IntegerType()), StructField("held", DoubleType())])
    wanted, spark = quotes.select("qid", "quote"), texts.sparkSession
    found = [rows.mapInArrow(_sharers(spark.sparkContext.broadcast(block), to_arrow_schema(kind)), kind) for block in _blocks(wanted, block_bytes, RUN_QUOTES, empty=True)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kind)


def _sharers(sent: Broadcast, kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map from texts, their last column, to what they share with every quote of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = [quote for quote, _ in sent.value]
        own, chars, search = pa.array([row[0] for _, row in sent.value], kind.types[0]), np.array([max(len(q), 1) for q in quotes]), Runs(quotes)
        step = max(1, RUN_ROWS // len(quotes))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = np.array([search.of(text.as_py()) for text in part.column(part.num_columns - 1)], np.int32)
                each = pa.array(np.repeat(np.arange(len(n)), len(quotes)))
                again = own.take(pa.array(np.tile(np.arange(len(quotes)), len(n))))
                yield pa.RecordBatch.from_arrays([again, *(c.take(each).cast(t) for c, t in zip(part.columns[:-1], kind.types[1:-2], strict=True)), pa.array(n.ravel()), pa.array((n / chars).ravel())], schema=kind)

    return run


def first_ranks(hits: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes (qid, quote, ...), each once, with rank: the first hit that holds the quote, or null. hits: as met() takes them."""
    best = met(hits, quotes).unionByName(quotes.withColumn("_rank", F.lit(None).cast(hits.schema["rank"].dataType)))
    return best.groupBy(*quotes.columns).agg(F.min("_rank").alias("rank"))


def best_ranks(ranked: DataFrame) -> DataFrame:
    """qid, strict, amended: best rank of gold answers, and of gold answers or equivalents; null where none was reached.

    ranked: first_ranks() of quotes with role (`answer`, `bridge`, `equivalent`); bridges do not score.
    """
    strict = F.min(F.when(F.col("role") == "answer", F.col("rank")))
    amended = F.min(F.when(F.col("role").isin("answer", "equivalent"), F.col("rank")))
    return ranked.groupBy("qid").agg(strict.alias("strict"), amended.alias("amended"))


def attribution(hits: DataFrame, quotes: DataFrame) -> DataFrame:
    """hits with label: the role of the passage that a hit holds, gold before equivalents, null for none.

    Of hits without a qid, that all quotes meet, only the labelled pairs: qid, rank, label.
    """
    order = F.when(F.col("role") == "answer", 0).when(F.col("role") == "bridge", 1).otherwise(2)
    label = met(hits, quotes.select("qid", "quote", "role")).groupBy("qid", F.col("_rank").alias("rank")).agg(F.min_by("role", order).alias("label"))
    return hits.join(label, ["qid", "rank"], "left") if "qid" in hits.columns else label


def tally(best: DataFrame, groups: DataFrame, cuts: tuple[int, int] = CUTS) -> DataFrame:
    """rule, group, n, found_at_low, found_at_high; group `overall` sums all. groups: qid, group."""
    rows = best.join(groups, "qid").select("group", F.explode(F.create_map(F.lit("strict"), "strict", F.lit("amended"), "amended")).alias("rule", "rank"))

    def found(cut: int) -> Column:
        return F.coalesce(F.count_if(F.col("rank") <= cut), F.lit(0))

    sums = rows.rollup("rule", "group").agg(F.count("*").alias("n"), found(cuts[0]).alias("found_at_low"), found(cuts[1]).alias("found_at_high"))
    return sums.filter("rule IS NOT NULL").withColumn("group", F.coalesce("group", F.lit("overall")))


def on_page(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages (pid, document, page, quote) with the chunks that span their page: an equi-join with a range."""
    return passages.join(chunks.select(F.col("id").alias("chunk_id"), "document", "page_start", "page_end", "text"), "document").filter(F.col("page").between(F.col("page_start"), F.col("page_end")))


def coverage(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """pid, covered, best_held, best_chunk: whether some chunk holds half of each passage, and which holds most (ties: greatest id)."""
    met = on_page(chunks, passages).withColumn("held", held(F.col("quote"), F.col("text")))
    best = met.groupBy("pid").agg(F.max(F.struct("held", "chunk_id")).alias("b"), F.bool_or(contains_half(F.col("text"), F.col("quote"))).alias("c"))
    return passages.select("pid").join(best, "pid", "left").select("pid", F.coalesce("c", F.lit(False)).alias("covered"), F.coalesce("b.held", F.lit(0.0)).alias("best_held"), F.col("b.chunk_id").alias("best_chunk"))


def _violations(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """rule, id, for every rule that a row breaks; a rule is broken where it is true."""
    broken = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull()))
    return rows.select(broken.alias("rule"), F.col(id_col).alias("id"))


def question_faults(questions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """rule, id of questions (id, kind, question, answer, hops, gold array<doc, page, role, quote>) that break a rule."""
    gold = F.coalesce(F.col("gold"), F.array().cast(questions.schema["gold"].dataType))
    multi = F.col("kind") == "multi-hop"
    places = F.array_distinct(F.transform(gold, lambda g: F.struct(g["doc"], g["page"])))
    chars = lambda g: F.length(spaced(g["quote"]))
    out = _violations(questions, "id", {
        "id_missing": F.coalesce(F.trim("id"), F.lit("")) == "",
        "kind_unknown": ~F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS),
        "question_empty": F.coalesce(F.trim("question"), F.lit("")) == "",
        "answer_empty": F.coalesce(F.trim("answer"), F.lit("")) == "",
        "gold_empty": F.size(gold) == 0,
        "role_unknown": F.exists(gold, lambda g: ~F.coalesce(g["role"], F.lit("")).isin(*ROLES)),
        "page_below_one": F.exists(gold, lambda g: F.coalesce(g["page"], F.lit(0)) < 1),
        "quote_length": F.exists(gold, lambda g: ~F.coalesce(chars(g), F.lit(0)).between(*QUOTE_CHARS)),
        "answer_passage_missing": ~F.exists(gold, lambda g: F.coalesce(g["role"], F.lit("")) == "answer"),
        "hops_missing": multi & (F.coalesce(F.trim("hops"), F.lit("")) == ""),
        "one_place_only": multi & ((F.size(gold) < 2) | (F.size(places) < 2)),
        "bridge_missing": multi & ~F.exists(gold, lambda g: F.coalesce(g["role"], F.lit("")) == "bridge"),
    })
    twice = questions.groupBy("id").count().filter("count > 1").select(F.lit("id_repeated").alias("rule"), "id")
    out = out.unionByName(twice)
    if pages is not None:
        quotes = questions.select("id", F.explode(gold).alias("g")).select("id", F.col("g.doc").alias("document"), F.col("g.page").alias("page"), F.col("g.quote").alias("quote"))
        out = out.unionByName(quote_faults(quotes, pages))
    return out


def quote_faults(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """rule, id of quotes (id, document, page, quote) whose page is not there or does not hold them word for word."""
    met = quotes.join(pages.select("document", "page", F.col("text").alias("_text")), ["document", "page"], "left")
    rule = F.when(F.col("_text").isNull(), "page_missing").when(~F.contains(spaced(F.col("_text")), spaced(F.col("quote"))), "not_verbatim")
    return met.select(rule.alias("rule"), "id").filter("rule IS NOT NULL")


def key_faults(raw: DataFrame, id_col: str, column: str, wanted: StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """rule, id of records whose JSON object in column lacks a wanted key or has another: `missing:key`, `unknown:key`; `no_object` if it is none."""
    keys = F.json_object_keys(column)
    names = [f.name for f in wanted.fields]
    lacking = F.array_except(F.array(*[F.lit(n) for n in names if n not in optional]), keys)
    rules = F.concat(F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, names)))), lambda k: F.concat(F.lit("unknown:"), k)), F.transform(F.array_sort(lacking), lambda k: F.concat(F.lit("missing:"), k)))
    return raw.select(F.explode(F.when(keys.isNull(), F.array(F.lit("no_object"))).otherwise(rules)).alias("rule"), F.col(id_col).cast("string").alias("id"))


def unlisted_documents(passages: DataFrame, manifest: DataFrame) -> DataFrame:
    """rule, id of passages (id, document) of documents that the manifest (slug) does not list."""
    lost = passages.join(manifest.select(F.col("slug").alias("document")).distinct(), "document", "left_anti")
    return lost.select(F.lit("document_unlisted").alias("rule"), "id")


def equivalent_faults(equivalents: DataFrame, questions: DataFrame, pages: DataFrame, amendment: int = 1, manifest: DataFrame | None = None) -> DataFrame:
    """rule, id of equivalents (id, amendment, document, page, quote) of questions (id, gold); manifest (slug): the documents that may be quoted."""
    gold = questions.select("id", F.explode("gold").alias("g")).select("id", F.col("g.doc").alias("document"), F.col("g.page").alias("page"), F.col("g.quote").alias("gold"))
    wrong = equivalents.filter(F.coalesce(F.col("amendment"), F.lit(-1)) != amendment).select(F.lit("amendment_wrong").alias("rule"), "id")
    unknown = equivalents.join(questions.select("id"), "id", "left_anti").select(F.lit("question_unknown").alias("rule"), "id")
    chars = equivalents.filter(~F.coalesce(F.length(spaced(F.col("quote"))), F.lit(0)).between(*QUOTE_CHARS)).select(F.lit("quote_length").alias("rule"), "id")
    near = equivalents.join(gold, ["id", "document", "page"])
    restated = near.filter(spaced(F.col("quote")) == spaced(F.col("gold"))).select(F.lit("restates_gold").alias("rule"), "id")
    placed = near.join(pages.select("document", "page", F.col("text").alias("_t")), ["document", "page"]).withColumn("a", span_on_page(F.col("_t"), F.col("quote"))).withColumn("b", span_on_page(F.col("_t"), F.col("gold")))
    over = placed.filter((spaced(F.col("quote")) != spaced(F.col("gold"))) & F.col("a").isNotNull() & F.col("b").isNotNull() & overlaps(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))).select(F.lit("overlaps_gold").alias("rule"), "id")
    listed = unlisted_documents(equivalents, manifest) if manifest is not None else wrong.limit(0)
    return wrong.union(unknown).union(chars).union(restated).union(over).union(listed).union(quote_faults(equivalents.select("id", "document", "page", "quote"), pages))


def span_overlaps(spans: DataFrame) -> DataFrame:
    """Pairs (id, document, page, i, j), i before j, of spans (id, document, page, i, start, end) that share over half of the shorter."""
    a, b = spans.alias("a"), spans.alias("b")
    same = (F.col("a.id") == F.col("b.id")) & (F.col("a.document") == F.col("b.document")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.i") < F.col("b.i"))
    return a.join(b, same).filter(overlaps(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))).select("a.id", "a.document", "a.page", F.col("a.i").alias("i"), F.col("b.i").alias("j"))


def group_faults(questions: DataFrame, groups: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """rule, id where questions (id, kind) and groups (id, group) disagree."""
    both = questions.select("id", "kind").join(groups.select("id", "group"), "id", "full")
    rule = (
        F.when(F.col("kind").isNull(), "question_unknown")
        .when(F.col("group").isNull(), "group_missing")
        .when(~F.col("group").isin(*labels), "label_unknown")
        .when(F.col("group").startswith("single") != F.col("kind").startswith("single"), "kind_differs")
    )
    return both.select(rule.alias("rule"), "id").filter("rule IS NOT NULL")


def verdict(faults: Callable[[], DataFrame], then: Callable[[], DataFrame] | None = None) -> tuple[int, DataFrame | None]:
    """0 if nothing is broken, 1 if something is, 2 if the sources cannot be read; and what is broken.

    then: checks that are stated against sources without faults, such as those of equivalents; skipped if there are any.
    """
    for check in filter(None, (faults, then)):
        try:
            found = check()
            broken = not found.isEmpty()
        except (PySparkException, Py4JJavaError) as problem:
            if not any(sign in str(problem) for sign in UNREADABLE):
                raise
            return 2, None
        if broken:
            return 1, found
    return 0, None


def last_rows(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """For each key the row with the greatest seq."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")
