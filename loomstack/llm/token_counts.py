"""Edit-aware token counts: a tree of pre-token sums per document, re-encoded only around edits.

A pre-token is what the tokenizer's pattern splits off; it is encoded alone, so a document's count is the sum over
its pre-tokens. These lie in blocks, whose characters and tokens a binary tree sums up. An edit finds its place by
descending the tree, splits anew from CONTEXT pre-tokens before it until a boundary after it falls where one was,
encodes these pre-tokens only, and updates the sums above the blocks it touched. A block that has outgrown SPLIT
times its size has the tree laid out anew; nothing is encoded for that.

Patterns may look back at nothing and ahead by one character, and past a run of white space, as those of the
byte-level tokenizers do; such a pattern's splits after a shared boundary are the same.

Defined results: a null text is empty and counts 0; null edits are none; an edit's places are clipped to the text, a
null replacement deletes; repeated rows are counted each; an empty table gives no rows; only the named columns are
read. A task holds a step's texts, or one longer text with two numbers for each of its pre-tokens, and the cache of
pre-token counts, which starts anew at CACHE entries or CACHE_CHARS characters.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.llm.common import steps

BLOCK, SPLIT, CONTEXT, CACHE, CACHE_CHARS = 64, 4, 3, 500_000, 16 << 20
#: Pre-tokens that are split off and counted at once.
TOGETHER = 1 << 16


class Counter:
    """Splits texts by a pattern and counts the tokens of pre-tokens, with a cache."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:  # installed with the tokenizers on every machine
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pattern, self.known, self.held = regex.compile(pattern), {}, 0

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> array:
        known = self.known
        try:
            return array("i", [known[p] for p in pieces])
        except KeyError:
            if len(known) > CACHE or self.held > CACHE_CHARS:
                known.clear()
                self.held = 0
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encode(p))
                    self.held += len(p)
            return array("i", [known[p] for p in pieces])

    def measured(self, text: str) -> tuple[array, array]:
        """Characters and tokens of the text's pre-tokens."""
        sizes, tokens = array("i"), array("i")
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > TOGETHER else iter(self.split(text))
        while pieces := list(islice(found, TOGETHER)):
            sizes.extend(map(len, pieces))
            tokens.extend(self.counts(pieces))
        return sizes, tokens


class Tree:
    """Characters and tokens of a document's pre-tokens, in blocks under a binary tree of sums."""

    def __init__(self, sizes: array, tokens: array):
        self._lay(sizes, tokens)
        self.encoded = 0

    def _lay(self, sizes: array, tokens: array) -> None:
        self.blocks = [(sizes[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [(array("i"), array("i"))]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = [(0, 0)] * self.width + [(sum(s), sum(t)) for s, t in self.blocks] + [(0, 0)] * (self.width - len(self.blocks))
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = a + c, b + d

    @property
    def total(self) -> int:
        return self.sums[1][1]

    @property
    def pieces(self) -> int:
        return sum(len(s) for s, _ in self.blocks)

    def _find(self, place: int) -> tuple[int, int]:
        """The block that holds a character's place, the last one for the end, and where the block begins."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place >= start + self.sums[i][0] and self.sums[i + 1][0]:
                start += self.sums[i][0]
                i += 1
        return i - self.width, start

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> str:
        """The text with [start, end) replaced; sums follow."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        block, at = self._find(max(start - 1, 0))
        begin, index, first = at, 0, block
        for size in self.blocks[block][0]:
            if begin + size >= start:
                break
            begin, index = begin + size, index + 1
        for _ in range(CONTEXT):  # step back over context, into earlier blocks too
            while index == 0 and first > 0:
                first -= 1
                index = len(self.blocks[first][0])
            if index == 0:
                break
            index -= 1
            begin -= self.blocks[first][0][index]
        edited, shift = text[:start] + new + text[end:], len(new) - (end - start)
        # walk the new splits and the old ones side by side until a boundary behind the edit is shared
        fresh, place, last, old, end_index = [], begin, first, begin, index
        done = False
        for match in counter.pattern.finditer(edited, begin):
            fresh.append(match.group())
            place = match.end()
            while old + shift < place or old < end:
                while last < len(self.blocks) and end_index >= len(self.blocks[last][0]):
                    last, end_index = last + 1, 0
                if last >= len(self.blocks):
                    break
                old, end_index = old + self.blocks[last][0][end_index], end_index + 1
            if old >= end and old + shift == place and place >= start + len(new):
                done = True
                break
        if not done:
            last, end_index = len(self.blocks) - 1, len(self.blocks[-1][0])
        last = min(last, len(self.blocks) - 1)
        self.encoded += len(fresh)
        self._splice(first, index, last, end_index, array("i", map(len, fresh)), counter.counts(fresh))
        return edited

    def _splice(self, first: int, index: int, last: int, end_index: int, sizes: array, tokens: array) -> None:
        head, tail = self.blocks[first], self.blocks[last]
        merged = head[0][:index] + sizes + tail[0][end_index:], head[1][:index] + tokens + tail[1][end_index:]
        self.blocks[first] = merged
        for i in range(first + 1, last + 1):
            self.blocks[i] = (array("i"), array("i"))
        if len(merged[0]) > SPLIT * BLOCK:
            self._lay(*self._flat())
            return
        touched = set()
        for i in range(first, last + 1):
            self.sums[self.width + i] = sum(self.blocks[i][0]), sum(self.blocks[i][1])
            touched.add((self.width + i) // 2)
        while touched:
            for i in touched:
                if i:
                    self._add(i)
            touched = {i // 2 for i in touched if i > 1}

    def _flat(self) -> tuple[array, array]:
        sizes, tokens = array("i"), array("i")
        for s, t in self.blocks:
            sizes += s
            tokens += t
        return sizes, tokens

    def dump(self) -> dict:
        sizes, tokens = self._flat()
        return {"sizes": sizes.tolist(), "tokens": tokens.tolist()}

    @staticmethod
    def load(state: dict) -> Tree:
        return Tree(array("i", state["sizes"]), array("i", state["tokens"]))


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(ranks: str, pattern: str) -> Counter:
    """One for each worker and tokenizer."""
    if (ranks, pattern) not in _COUNTERS:
        _COUNTERS[ranks, pattern] = Counter(ranks, pattern)
    return _COUNTERS[ranks, pattern]


_TREE = pa.struct([("sizes", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
_TREE_SQL = "struct<sizes:array<int>,tokens:array<int>>"


def _mapped(rows: DataFrame, id_col: str, text: str, extra: list[tuple[str, pa.DataType, str]], each: Callable) -> DataFrame:
    """A narrow map: each(row values without the id) gives the extra columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _, _ in steps(batches, text):
            for low in range(0, whole.num_rows, 1024):
                part = whole.slice(low, 1024)
                out = [each(*v) for v in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(zip(*out, strict=True), extra, strict=True))], [id_col, *(n for n, _, _ in extra)])

    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {dict(rows.dtypes)[id_col]}", *(f"{n} {s}" for n, _, s in extra)]))


def build(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_tokens, tree: the state that apply() keeps up to date."""

    def each(text: str | None) -> tuple:
        own = counter(ranks, pattern)
        tree = Tree(*own.measured(text or ""))
        return tree.total, tree.dump()

    return _mapped(docs.select(id_col, text), id_col, text, [("n_tokens", pa.int64(), "long"), ("tree", _TREE, _TREE_SQL)], each)


def apply(states: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text", tree: str = "tree", edits: str = "edits") -> DataFrame:
    """id_col, text, n_tokens, n_encoded, tree after edits (array<struct<start,end,text>>, in order, in code points of the text before each)."""

    def each(text: str | None, state: dict, edits: list[dict] | None) -> tuple:
        own, now, held = counter(ranks, pattern), text or "", Tree.load(state)
        for e in edits or []:
            now = held.edit(now, e["start"], e["end"], e["text"] or "", own)
        return now, held.total, held.encoded, held.dump()

    return _mapped(states.select(id_col, text, tree, edits), id_col, text, [("text", pa.string(), "string"), ("n_tokens", pa.int64(), "long"), ("n_encoded", pa.int64(), "long"), ("tree", _TREE, _TREE_SQL)], each)


def revise(docs: DataFrame, edits: Column, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts before and after edits without storing trees: id_col, n_tokens, n_tokens_edited, n_pieces, n_encoded."""

    def each(text: str | None, edits: list[dict] | None) -> tuple:
        own, now = counter(ranks, pattern), text or ""
        tree = Tree(*own.measured(now))
        before, pieces = tree.total, tree.pieces
        for e in edits or []:
            now = tree.edit(now, e["start"], e["end"], e["text"] or "", own)
        return before, tree.total, pieces, tree.encoded

    longs = [(n, pa.int64(), "long") for n in ("n_tokens", "n_tokens_edited", "n_pieces", "n_encoded")]
    return _mapped(docs.select(id_col, text, edits.alias("_edits")), id_col, text, longs, each)


def sample_revision(text: str = "text") -> Column:
    """Three edits for any text, from back to front: a replacement, an insertion and a deletion."""
    n = F.coalesce(F.length(text), F.lit(0))

    def edit(part: float, wide: int, new: str) -> Column:
        at = F.floor(n * part).cast("int")
        return F.struct(at.alias("start"), (at + wide).alias("end"), F.lit(new).alias("text"))

    return F.array(edit(0.75, 5, "Edited"), edit(0.5, 0, " as amended, 2026"), edit(0.25, 7, ""))
