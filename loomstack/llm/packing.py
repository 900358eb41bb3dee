"""Sequence packing as vector bin packing: tokens, segments and loss-bearing tokens are limited at once.

Each task packs the documents of its partition as they come, from a pool of bounded size. The open sequence
takes, again and again, the waiting piece that fits all three limits and whose demand has the greatest dot
product with what the sequence has left (both as shares of the limits). When none fits whole, the greatest is
cut at the limit. What is left at the end of a task is laid into sequences whose lengths are powers of two
(down to SHORTEST), so no sequence but the last of a task needs padding.

Every id bears loss, unless a column of spans tells which characters do, as format_chats() gives it: a text is then cut
at the spans' borders and each part encoded alone, ids of spans bear loss, and so does the end token of a text with
any such id.

Nothing is shuffled, and a task's memory holds the pool, one batch, and a cache of bounded entries and bytes, however
long its partition is. A text longer than a step is encoded in parts that end at white space.

Defined results: a null text is empty and packs as its end token alone; null spans are none, spans are clipped to the
text and may overlap; repeated rows are packed each; a null id is passed on; an empty table gives no rows; only the
named columns are read. Sequence numbers are unique: the task's partition times 2**40 plus a count.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomstack.llm.common import STEP_BYTES, steps

TOKENS, SEGMENTS, END = 2048, 256, 1
#: Pieces that wait in a task.
POOL = 256
#: The shortest sequence that a task's leftover is cut into.
SHORTEST = 64
#: Units, and their bytes, that a worker's cache of token ids holds before it starts anew; a dictionary's table doubles just beyond.
CACHE, CACHE_BYTES = 690_000, 64 << 20
#: Words encoded at once.
GROUP = 500

_SPACE = re.compile(rb"[ \t-\r]")


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about this size that end at white space; a longer unit is not cut."""
    low = 0
    while low < len(text):
        cut = _SPACE.search(text, low + size)
        high = cut.end() if cut else len(text)
        yield text[low:high]
        low = high


def _ragged(first: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at of a ragged array, joined, and their lengths."""
    low, wide = first[at], first[at + 1] - first[at]
    return ids[np.arange(int(wide.sum())) + np.repeat(low - (wide.cumsum() - wide), wide)], wide


class UnitTokenizer:
    """Token ids of whole texts by ids of their white-space-delimited units.

    For tokenizers that never join text across white space, as those that split on it and drop it. Units of Latin
    letters, digits and signs are split into words here, if the file says by which pattern and that words are
    lower-cased; their distinct words are then encoded many at once, and the ids that end a word tell them apart.
    All other units, and groups where that count is not as it should be, are encoded one by one as they are.
    """

    #: No white space, control or combining characters: normal form C as it stands, and lower-cased one to one.
    PLAIN = regex.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]+(?: [\x21-\x7e\xa1-\u012f\u0131-\u024f]+)*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words = self._word_model(json.loads(self.model.to_str()))
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.reset()

    def _word_model(self, form: dict) -> object | None:
        """The same model without normalising and splitting, if these are the steps that words() takes."""
        from tokenizers import Tokenizer

        kinds = [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])]
        split, *rest = (form["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        suffix = form["model"].get("end_of_word_suffix")
        if kinds != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split["invert"] or split["behavior"] != "Removed" or not suffix:
            return None
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.ends = np.zeros(1 + max(form["model"]["vocab"].values()), bool)
        self.ends[[i for w, i in form["model"]["vocab"].items() if w.endswith(suffix)]] = True
        return Tokenizer.from_str(json.dumps(form | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}))

    def reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain units, joined, and their lengths."""
        split = [[u] if u.isalpha() else self.pattern.findall(u) for u in units]
        distinct = list(dict.fromkeys(w for own in split for w in own))
        ids = [np.array(self.words.encode_batch_fast([" ".join(distinct[i : i + GROUP])], add_special_tokens=False)[0].ids, np.int32) for i in range(0, len(distinct), GROUP)]
        if any(self.ends[own].sum() != len(distinct[i * GROUP : (i + 1) * GROUP]) for i, own in enumerate(ids)):
            return None
        ids = np.concatenate(ids)
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        at = np.fromiter((number[w] for own in split for w in own), np.int64)
        flat, wide = _ragged(np.r_[0, np.flatnonzero(self.ends[ids]) + 1], ids, at)
        parts = np.fromiter(map(len, split), np.int64, len(split))
        return flat, np.add.reduceat(wide, parts.cumsum() - parts)

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(units, add_special_tokens=False)]
        return np.fromiter((i for own in ids for i in own), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        if self.words and (not self.PLAIN.fullmatch(joined := " ".join(texts)) or any(s in joined for s in self.special)):
            plain = [bool(self.PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
            order = [i for i, k in enumerate(plain) if k] + [i for i, k in enumerate(plain) if not k]
            units, texts, some = [units[i] for i in order], [texts[i] for i in order], sum(plain)
        else:
            some = len(texts) if self.words else 0
        done = (self._plain([t.lower() for t in texts[:some]]) or self._one_by_one(texts[:some])) if some else (self.ids[:0], self.first[:0])
        rest = self._one_by_one(texts[some:])
        self.ids = np.concatenate([self.ids, done[0], rest[0]])
        self.first = np.r_[self.first, self.first[-1] + np.r_[done[1], rest[1]].cumsum()]
        self.held += sum(map(len, units))
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units)), strict=True))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > STEP_BYTES:
            return [np.concatenate([self._encoded([part])[0] for part in _parts(texts[0], STEP_BYTES)])]
        return self._encoded(texts)

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.place) > CACHE or self.held > CACHE_BYTES:
            self.reset()
        units = [t.split() for t in texts]  # of bytes: ASCII white space only
        if new := [u for u in set(chain.from_iterable(units)) if u not in self.place]:
            self._learn(new)
        count = np.fromiter(map(len, units), np.int64, len(units))
        flat, wide = _ragged(self.first, self.ids, np.fromiter(map(self.place.__getitem__, chain.from_iterable(units)), np.int64, int(count.sum())))
        cut = np.r_[0, wide.cumsum()][np.r_[0, count.cumsum()]]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_LOADED: dict[str, UnitTokenizer] = {}


def unit_tokenizer(path: str) -> UnitTokenizer:
    """One for each worker and file."""
    if path not in _LOADED:
        _LOADED[path] = UnitTokenizer(path)
    return _LOADED[path]


class Packer:
    """A stream of (name, ids, loss-bearing flags or None for all) into pieces (name, start, ids, total, sequence, offset, loss-bearing ids)."""

    def __init__(self, limits: tuple[int, int, int], pool: int, first: int):
        self.limits, self.pool, self.sequence = np.array(limits, float), pool, first
        self.waiting: list[list] = []  # name, start, ids, loss, total
        self.demand = np.zeros((pool + 1, 3))
        self.left, self.offset = self.limits.copy(), 0

    def _close(self) -> None:
        if self.offset:
            self.sequence, self.left, self.offset = self.sequence + 1, self.limits.copy(), 0

    def _put(self, piece: list, n: int) -> tuple:
        name, start, ids, loss, total = piece
        bears = n if loss is None else int(loss[:n].sum())
        out = (name, start, ids[:n], total, self.sequence, self.offset, bears)
        self.left -= (n, 1, bears)
        self.offset += n
        return out

    def _room(self, piece: list) -> int:
        """Ids of the piece that the open sequence can still take."""
        _, _, ids, loss, _ = piece
        if self.left[1] < 1:
            return 0
        n = int(min(len(ids), self.left[0]))
        return int(min(n, self.left[2])) if loss is None else int(np.searchsorted(loss[:n].cumsum(), self.left[2], "right"))

    @staticmethod
    def _cut(piece: list, n: int) -> list:
        name, start, ids, loss, total = piece
        return [name, start + n, ids[n:], None if loss is None else loss[n:], total]

    def _demand(self, piece: list) -> tuple:
        return len(piece[2]), 1, len(piece[2]) if piece[3] is None else int(piece[3].sum())

    def _fill(self) -> Iterator[tuple]:
        """Packs one sequence from the waiting pieces."""
        n = len(self.waiting)
        demand = self.demand[:n]
        open_, cut = np.ones(n, bool), None
        while True:
            score = demand @ (self.left / self.limits / self.limits)
            fit = open_ & (demand <= self.left).all(axis=1)
            if fit.any():
                best = int(np.where(fit, score, -1).argmax())
                yield self._put(self.waiting[best], len(self.waiting[best][2]))
                open_[best] = False
                continue
            if open_.any():
                best = int(np.where(open_, score, -1).argmax())
                if room := self._room(self.waiting[best]):
                    yield self._put(self.waiting[best], room)
                    self.waiting[best], cut = self._cut(self.waiting[best], room), best
            break
        if cut is not None:
            demand[cut] = self._demand(self.waiting[cut])
        kept = np.flatnonzero(open_)
        self.waiting = [self.waiting[i] for i in kept.tolist()]
        self.demand[: len(kept)] = demand[kept]
        self._close()

    def add(self, name: object, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        piece = [name, 0, ids, loss, len(ids)]
        while len(piece[2]) >= self.limits[0] and (room := self._room(piece)):  # only while no sequence is open
            yield self._put(piece, room)
            piece = self._cut(piece, room)
            self._close()
        if len(piece[2]):
            self.demand[len(self.waiting)] = self._demand(piece)
            self.waiting.append(piece)
        if len(self.waiting) > self.pool:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while sum(len(p[2]) for p in self.waiting) >= self.limits[0]:
            yield from self._fill()
        limits = self.limits.copy()
        while self.waiting:
            rest = sum(len(p[2]) for p in self.waiting)
            self.left[0] = 1 << (rest.bit_length() - 1) if rest >= SHORTEST else rest
            yield from self._fill()
        self.limits = limits


def _masked(texts: list[bytes], spans: list[list[dict] | None], encode: UnitTokenizer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of every text, whose parts inside and outside its spans are encoded alone, and which of them bear loss."""
    cut, bears, count = [], [], []
    for text, own in zip(texts, spans, strict=True):
        said, at, before = text.decode(), 0, len(cut)
        for s in sorted((max(s["start"], 0), s["end"]) for s in own or [] if s is not None and s["start"] is not None and s["end"] is not None):
            low, high = max(s[0], at), min(s[1], len(said))
            if low < high:
                cut += [said[at:low].encode(), said[low:high].encode()]
                bears += [False, True]
                at = high
        cut.append(said[at:].encode())
        bears.append(False)
        count.append(len(cut) - before)
    ids = encode(cut) if max(map(len, cut), default=0) <= STEP_BYTES else [encode([c])[0] for c in cut]
    low = 0
    for n in count:
        own = ids[low : low + n]
        yield np.concatenate(own), np.repeat(bears[low : low + n], [len(i) for i in own])
        low += n


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None, end: int = END, pool: int = POOL, loss: str | None = None) -> DataFrame:
    """Pieces of all documents: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_length.

    tokenizer: the path, on every machine, of a file for UnitTokenizer. loss: a column of array<struct<start, end>>, the
    spans of code points that bear loss; without it all ids do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = unit_tokenizer(tokenizer), Packer((tokens, segments, loss_tokens or tokens), pool, TaskContext.get().partitionId() << 40)
        found: list[tuple] = []
        for rows, raw, at in steps(batches, text):
            data = raw.tobytes()
            names = rows.column(rows.schema.get_field_index(id_col)).to_pylist()
            texts = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if loss:
                own = _masked(texts, rows.column(rows.schema.get_field_index(loss)).to_pylist(), encode)
            else:
                own = ((ids, None) for ids in encode(texts))
            for name, (ids, bears) in zip(names, own, strict=True):
                found += map(_row, packer.add(name, np.append(ids, np.int32(end)), None if bears is None else np.append(bears, bears.any())))
            if len(found) >= 4096:
                yield _batch(found, kind)
                found = []
        found += map(_row, packer.finish())
        if found:
            yield _batch(found, kind)

    if min(tokens, segments, loss_tokens or tokens) < 1:
        raise ValueError("every limit must be at least 1")
    source = docs.select(id_col, text, *([loss] if loss else []))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_length")
    kind = pa.schema([(id_col, _arrow(source, id_col)), *((n, pa.int64()) for n in longs)])
    return source.mapInArrow(run, ", ".join([f"`{id_col}` {dict(source.dtypes)[id_col]}", *(f"{n} long" for n in longs)]))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _row(piece: tuple) -> tuple:
    name, start, ids, total, sequence, offset, bears = piece
    return name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, bears


def _batch(found: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kind.types, strict=True)], schema=kind)
