"""Pages to chunks: pages, paragraphs and sentences by column expressions, packing by groups.

Packing carries state from chunk to chunk, so a segment (a run of kept pages of one document) is one group; its units
are bounded by the document, and segments spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: where a sentence ends and the next one begins.
SENTENCE = r"""(?U)(?<=[.!?])\s+(?=["'(\[]?[A-Z0-9])"""


@dataclass(frozen=True)
class Limits:
    most: int = 1400
    overlap: int = 200
    least: int = 300

    @property
    def unit(self) -> int:
        """Longest unit: a chunk below `least` can always take the one before it."""
        return self.most - self.least - 2


def split_pages(texts: DataFrame) -> DataFrame:
    """document, seq, page, text from (document, text) with page marks; what stands before the first mark is left out."""
    parts = texts.select("document", F.posexplode(F.split("text", r"(?m)(?=^\f--- page \d+ ---$)")).alias("seq", "part"))
    number = F.regexp_extract("part", r"(?s)\A\f--- page (\d+) ---", 1)
    return parts.filter(number != "").select("document", "seq", number.cast("int").alias("page"), F.regexp_replace("part", r"\A\f--- page \d+ ---", "").alias("text"))


def page_map(texts: DataFrame) -> DataFrame:
    """document, page, text: of pages with one number the last one."""
    return split_pages(texts).groupBy("document", "page").agg(F.max_by("text", "seq").alias("text"))


def segmented(pages: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """pages without the skipped (document, page), with segment: a number that grows where a page was left out."""
    if skipped is None:
        return pages.withColumn("segment", F.lit(0))
    marked = pages.join(skipped.select("document", "page", F.lit(1).alias("_skip")).distinct(), ["document", "page"], "left")
    holes = F.coalesce(F.sum("_skip").over(Window.partitionBy("document").orderBy("seq")), F.lit(0))
    kept = marked.withColumn("segment", holes.cast("int")).filter("_skip IS NULL").drop("_skip")
    return kept.select(*pages.columns, "segment")


def units(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """document, segment, seq, para, sent, piece, page, text, starts_paragraph: what a chunk's border may fall between."""
    paras = pages.select("document", "segment", "seq", "page", F.posexplode(F.split("text", r"(?U)\n\s*\n")).alias("para", "t"))
    paras = paras.withColumn("t", F.trim(F.regexp_replace("t", r"(?U)[^\S\n]*\n[^\S\n]*", " "))).withColumn("t", F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).filter("t <> ''")
    sents = paras.select("document", "segment", "seq", "para", "page", F.posexplode(F.split("t", SENTENCE)).alias("sent", "s"))
    pieces = sents.select("document", "segment", "seq", "para", "sent", "page", F.posexplode(hard_split(limits.unit)("s")).alias("piece", "text"))
    return pieces.withColumn("starts_paragraph", (F.col("sent") == 0) & (F.col("piece") == 0))


def cut_words(text: str, limit: int) -> list[str]:
    """Pieces of at most limit characters, cut at spaces; a longer word is cut inside."""
    if len(text) <= limit:
        return [text]
    out, line = [], []
    room = limit
    for word in text.split(" "):
        need = len(word) + bool(line)
        if need > room and line:
            out.append(" ".join(line))
            line, room, need = [], limit, len(word)
        if need > limit:
            whole = len(word) // limit * limit
            out += [word[i : i + limit] for i in range(0, whole, limit)]
            word = word[whole:]
            need = len(word)
            if not word:
                continue
        line.append(word)
        room -= need
    return [*out, " ".join(line)] if line else out


def hard_split(limit: int):
    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: cut_words(t, limit))

    return split


def pack(sizes: list[int], breaks: list[bool], limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Ranges of units for chunks: filled to `most`, each carrying back at least `overlap` of the one before, if at most half a chunk.

    A tail that leaves no room for the next unit is not carried; a chunk under `least` reaches back while it fits.
    """
    gaps = [2 if b else 1 for b in breaks]
    ends = list(accumulate(s + g for s, g in zip(sizes, gaps, strict=True)))

    def width(a: int, b: int) -> int:
        return ends[b - 1] - (ends[a - 1] if a else 0) - gaps[a] if b > a else 0

    def carried(a: int, b: int) -> int:
        tail = next((i for i in range(b - 1, a, -1) if width(i, b) >= limits.overlap), a + 1 if b - 1 > a else b)
        while tail < b and width(tail, b) > limits.most // 2:
            tail += 1
        return tail

    out, start, done, n = [], 0, 0, len(sizes)
    while done < n:
        # the last unit up to which a chunk from start fits
        stop = bisect_left(range(n), True, lo=done, key=lambda i: width(start, i + 1) > limits.most)
        if stop == done and start < done:
            start = done
            continue
        stop = max(stop, done + 1)
        out.append((start, stop))
        done, start = stop, carried(start, stop)
    grown = []
    for a, b in out:
        while a > 0 and width(a, b) < limits.least and width(a - 1, b) <= limits.most:
            a -= 1
        grown.append((a, b))
    return grown


def packed(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """document, segment, nth, page_start, page_end, text from units."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "para", "sent", "piece"])
        texts, breaks, pages = pdf["text"].tolist(), pdf["starts_paragraph"].tolist(), pdf["page"].tolist()
        out = []
        for nth, (a, b) in enumerate(pack([len(t) for t in texts], breaks, limits)):
            text = texts[a] + "".join(("\n\n" if breaks[i] else " ") + texts[i] for i in range(a + 1, b))
            out.append((pdf["document"].iloc[0], pdf["segment"].iloc[0], nth, min(pages[a:b]), max(pages[a:b]), text))
        return pd.DataFrame(out, columns=["document", "segment", "nth", "page_start", "page_end", "text"])

    return rows.groupBy("document", "segment").applyInPandas(one, "document string, segment int, nth int, page_start int, page_end int, text string")


def chunk(pages: DataFrame, skipped: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """id, document, page_start, page_end, ordinal, text of all documents' pages (document, seq, page, text)."""
    found = packed(units(segmented(pages, skipped), limits), limits)
    ordinal = F.row_number().over(Window.partitionBy("document").orderBy("segment", "nth")) - 1
    numbered = found.withColumn("ordinal", ordinal)
    return numbered.select(F.format_string("%s:%04d", "document", "ordinal").alias("id"), "document", "page_start", "page_end", "ordinal", "text")


def size_report(chunks: DataFrame) -> DataFrame:
    """document, n, least, median, most characters, with a row ALL; medians are rounded half to even."""
    length = F.length("text")
    by = chunks.rollup("document").agg(F.count("*").alias("n"), F.min(length).alias("least"), F.bround(F.percentile(length, F.lit(0.5))).cast("int").alias("median"), F.max(length).alias("most"))
    return by.select(F.coalesce("document", F.lit("ALL")).alias("document"), "n", "least", "median", "most")
