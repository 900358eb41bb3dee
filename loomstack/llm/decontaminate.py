"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by token windows.

Words are maximal runs of ASCII letters (lower-cased), digits and all non-ASCII characters. A window is n
consecutive words of an item; an item of fewer words (but not none) is one window. A hash only proposes a
window; its words are then compared, so hits are exact.

The set is a few numbers for each window beside the items' words: about 30 bytes a window and at most 16 more
for the table that rules most document windows out. A benchmark of over BLOCK_BYTES of text is scanned in blocks
of that size (an item longer than a block is a block of its own). A document longer than a step is read in pieces
that end between words, carrying the last words of one piece to the next.

Defined results: a null or wordless text has no words and no hits; a null item text has no windows; a null
item_id counts as one item with an empty id; rows with the same item_id are one item; repeated documents
are judged row by row; an empty benchmark hits nothing; no column but the named ones is read, so extra
columns cannot clash (remove() passes all of them on unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.llm.common import LOWER, STEP_BYTES, Powers, materialize, mix, runs, steps

WINDOW = 13
#: Bytes of benchmark text in one broadcast set; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 16 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BYTES, _WORDS, _AGAIN = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F), Powers(0xD6E8FEB86659FD93)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of words; no word crosses a row's border in at."""
    low = LOWER[raw]
    starts, ends = runs(_WORD[low], at)
    return low, starts, ends, mix(_BYTES.spans(low.astype(np.uint64), starts, ends))


def pieces(raw: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A long text as (place, lower-cased bytes, starts, ends, hashes of words) of pieces; a word longer than a step is one piece."""
    a, n = 0, len(raw)
    while a < n:
        b = min(a + step, n)
        if b < n:
            gaps = np.flatnonzero(~_WORD[raw[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                while b < n:
                    gaps = np.flatnonzero(~_WORD[raw[b : b + step]])
                    b += int(gaps[0]) if len(gaps) else len(raw[b : b + step])
                    if len(gaps):
                        break
        if b - a > step:
            low = LOWER[raw[a:b]]
            yield a, low, np.array([0]), np.array([b - a]), np.array([xxhash.xxh64_intdigest(low)], np.uint64)
        else:
            yield a, *words_of(raw[a:b], np.array([0, b - a]))
        a = b


class Windows:
    """Windows of k words: sorted hashes, and for each of them its first place among the words and its items."""

    def __init__(self, k: int, hashes: np.ndarray, first: np.ndarray, item: np.ndarray):
        """hashes of all words; the places where windows begin, and their items."""
        one, two = (mix(p.spans(hashes, first, first + k)) for p in (_WORDS, _AGAIN))
        order = np.lexsort((item, two, one))
        one, two, first, item = one[order], two[order], first[order], item[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        heads = np.flatnonzero(new)
        self.k, self.hashes, self.first = k, one[heads], first[heads].astype(np.int32)
        self.item = item[fresh].astype(np.int32)
        self.border = np.r_[fresh.cumsum()[heads] - 1, len(self.item)].astype(np.int32)
        self.shift = np.uint64(64 - max(16, int(8 * len(heads) - 1).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.hashes >> self.shift] = True

    def near(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text's word hashes where a window of equal hash begins, and the first such window."""
        if len(hashes) < self.k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.arange(len(hashes) - self.k + 1)
        own = mix(_WORDS.spans(hashes, begin, begin + self.k))
        at = np.flatnonzero(self.table[own >> self.shift])
        which = np.searchsorted(self.hashes, own[at])
        same = self.hashes[np.minimum(which, len(self.hashes) - 1)] == own[at]
        return at[same], which[same]


class TestSet:
    """Windows of a block of the benchmark by their length, the words of its items, and the items' names."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = [(text or "").encode() for _, text in items]
        size, low, hashes, length, row = 0, [], [], [], []
        held: list[int] = []

        def take(low_: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, rows: np.ndarray) -> None:
            wide = ends - starts
            kept = np.full(int(wide.sum()) + len(wide), 32, np.uint8)  # each word and a space
            inside = np.ones(len(kept), bool)
            inside[(wide + 1).cumsum() - 1] = False
            kept[inside] = low_[_WORD[low_]]
            low.append(kept), hashes.append(own), length.append(wide.astype(np.int32)), row.append(rows.astype(np.int32))

        def together() -> None:
            raw = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)
            at = np.r_[0, np.cumsum([len(texts[i]) for i in held])]
            low_, starts, ends, own = words_of(raw, at)
            take(low_, starts, ends, own, np.array(held)[np.searchsorted(at, starts, "right") - 1] if len(starts) else starts)

        for i, text in enumerate(texts):
            if len(text) > STEP_BYTES:
                for _, low_, starts, ends, own in pieces(np.frombuffer(text, np.uint8)):
                    take(low_, starts, ends, own, np.full(len(starts), i))
            elif text:
                if size + len(text) > STEP_BYTES:
                    together()
                    size, held = 0, []
                held.append(i)
                size += len(text)
        if held:
            together()
        hashes, length, row = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (length, np.int64), (row, np.int32)))
        order = np.argsort(row, kind="stable")  # long items came before shorter ones that waited
        if len(order) and (np.diff(row) < 0).any():
            border = np.r_[0, (length + 1).cumsum()]
            whole = np.concatenate(low)
            low = [np.concatenate([whole[border[i] : border[i + 1]] for i in order])]
            hashes, length, row = hashes[order], length[order], row[order]
        self.low = np.concatenate(low) if low else np.zeros(0, np.uint8)
        self.at = np.r_[0, (length + np.int64(1)).cumsum()]
        self.at = self.at.astype(np.uint32) if self.at[-1] < 1 << 32 else self.at
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        item = np.array([number[name] for name, _ in items], np.int32)
        count = np.bincount(row, minlength=len(items)) if len(row) else np.zeros(len(items), np.int64)
        start = count.cumsum() - count
        self.windows = []
        for k in np.unique(np.minimum(count, window)):
            if not k:
                continue
            rows = np.flatnonzero(np.minimum(count, window) == k)
            times = count[rows] - k + 1
            first = np.repeat(start[rows] - (times.cumsum() - times), times) + np.arange(times.sum())
            self.windows.append(Windows(int(k), hashes, first, np.repeat(item[rows], times)))
        self.most = max((w.k for w in self.windows), default=1)

    def nbytes(self) -> int:
        return self.low.nbytes + self.at.nbytes + sum(a.nbytes for w in self.windows for a in (w.hashes, w.first, w.item, w.border, w.table))

    def verified(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, row: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Hit flags of a text's words, and (word, length's number, window) of the windows found, all words compared."""
        hit, found = np.zeros(len(starts), bool), []
        for n, w in enumerate(self.windows):
            at, which = w.near(hashes)
            if row is not None and len(at):
                inside = row[at] == row[at + w.k - 1]
                at, which = at[inside], which[inside]
            for i, g in zip(at.tolist(), which.tolist(), strict=True):
                own = b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + w.k], ends[i : i + w.k], strict=True))
                code = w.hashes[g]
                while g < len(w.hashes) and w.hashes[g] == code:
                    first = w.first[g]
                    if own == self.low[self.at[first] : self.at[first + w.k] - 1].tobytes():
                        hit[i : i + w.k] = True
                        found.append((i, n, g))
                        break
                    g += 1
        return hit, found

    def items(self, found: set[tuple[int, int]]) -> list[str]:
        """Names of the items that have one of the windows (length's number, window)."""
        if not found:
            return []
        every = [w.item[w.border[g] : w.border[g + 1]] for w, g in ((self.windows[n], g) for n, g in found)]
        return [self.names[i] for i in np.unique(np.concatenate(every))]

    def scan(self, raw: np.ndarray, at: np.ndarray) -> list[dict]:
        """What mark() tells of each row."""
        if len(at) == 2 and len(raw) > STEP_BYTES:
            return [self._long(raw)]
        low, starts, ends, hashes = words_of(raw, at)
        first = np.searchsorted(starts, at)
        row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        hit, found = self.verified(low, starts, ends, hashes, row)
        windows: dict[int, set] = {}
        for i, n, g in found:
            windows.setdefault(int(row[i]), set()).add((n, g))
        out = [{"n_words": int(n), "spans": [], "items": []} for n in np.diff(first)]
        for r, own in windows.items():
            a, b = first[r], first[r + 1]
            out[r]["spans"], out[r]["items"] = _spans(hit[a:b], starts[a:b] - at[r], ends[a:b] - at[r], 0), self.items(own)
        return out

    def _long(self, raw: np.ndarray) -> dict:
        """One row, piece by piece."""
        low, starts, ends, hashes, place, hit = np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        done, spans, windows = 0, [], set()
        for at, low_, starts_, ends_, hashes_ in pieces(raw):
            starts, ends, place = np.r_[starts, starts_ + len(low)], np.r_[ends, ends_ + len(low)], np.r_[place, starts_ + at]
            low, hashes = np.concatenate([low, low_]), np.concatenate([hashes, hashes_])
            now, found = self.verified(low, starts, ends, hashes, None)
            now[: len(hit)] |= hit
            windows |= {(n, g) for _, n, g in found}
            n = max(len(starts) - self.most + 1, 0)  # words that no later window reaches
            spans = _united(spans, _spans(now[:n], place[:n], place[:n] + ends[:n] - starts[:n], done))
            cut = int(starts[n]) if n < len(starts) else len(low)
            low, starts, ends, hashes, place, hit, done = low[cut:].copy(), starts[n:] - cut, ends[n:] - cut, hashes[n:], place[n:], now[n:], done + n
        spans = _united(spans, _spans(hit, place, place + ends - starts, done))
        return {"n_words": done + len(starts), "spans": spans, "items": self.items(windows)}


def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> list[dict]:
    """Runs of hit words; starts and ends in bytes of the row, base the number of its first word here."""
    if not hit.any():
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False])).reshape(-1, 2).tolist()
    return [{"start": int(starts[i]), "end": int(ends[j - 1]), "words": j - i, "first": base + i} for i, j in edges]


def _united(a: list[dict], b: list[dict]) -> list[dict]:
    """Spans that cover the words of either list; touching ones become one."""
    if not a or not b:
        return a or b
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: s["first"]) if b[0]["first"] < a[-1]["first"] + a[-1]["words"] else [*a, *b]:
        if out and s["first"] <= (last := out[-1])["first"] + last["words"]:
            stop = max(last["first"] + last["words"], s["first"] + s["words"])
            out[-1] = {"start": last["start"], "end": max(last["end"], s["end"]), "words": stop - last["first"], "first": last["first"]}
        else:
            out.append(s)
    return out


def _test_sets(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[TestSet]:
    """Broadcast-sized sets: the benchmark's distinct rows, as they stream to the driver, in blocks of at most block_bytes of text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text <> ''").distinct()
    held, size, sets = [], 0, 0
    for r in items.toLocalIterator():
        wide = len(r["text"].encode())
        if held and size + wide > block_bytes:
            yield TestSet(held, window)
            held, size, sets = [], 0, sets + 1
        held.append((r["item_id"], r["text"]))
        size += wide
    if held or not sets:
        yield TestSet(held, window)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with struct column _hit: n_words, the hit spans (UTF-8 byte places, [start, end)) and their items.

    One narrow map per block of the benchmark; between blocks the rows are written to the shared folder.
    """
    spark = docs.sparkSession
    kind = "struct<n_words:long,spans:array<struct<start:int,end:int,words:int,first:int>>,items:array<string>>"
    marked = docs.withColumn("_hit", F.lit(None).cast(kind))
    for block, tests in enumerate(_test_sets(benchmark, window, block_bytes)):
        sent = spark.sparkContext.broadcast(tests)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for rows, raw, at in steps(batches, text):
                place = rows.schema.get_field_index("_hit")
                out = sent.value.scan(raw, at)
                for own, old in zip(out, rows.column(place).to_pylist(), strict=True):
                    if old and old["items"]:
                        own["spans"] = _united(old["spans"], own["spans"])
                        own["items"] = [*old["items"], *own["items"]]
                    own["items"] = sorted(set(own["items"]))
                yield rows.set_column(place, rows.schema.field(place), pa.array(out, rows.schema.field(place).type))

        marked = marked if block == 0 else materialize(marked, "decontaminate")
        marked = marked.mapInArrow(scan, marked.schema)
    return marked


def judged(share: int = 20) -> list[Column]:
    """Digest columns of a marked row; contaminated: at least one word in share is hit."""
    hit = F.aggregate("_hit.spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return [
        F.col("_hit.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_hit.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_hit.items"), 256).alias("items_sha256"),
        ((hit > 0) & (F.lit(share).cast("long") * hit >= F.col("_hit.n_words"))).alias("contaminated"),
    ]


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One digest row for each document row."""
    return mark(docs.select(id_col, text), benchmark, text, **options).select(id_col, *judged())


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "document", text: str = "text", share: int = 20, **options) -> DataFrame:
    """Documents without contamination: how="document" drops contaminated rows, how="span" cuts every hit span out of its text."""
    marked = mark(docs, benchmark, text, **options)
    if how == "document":
        return marked.filter(~judged(share)[-1]).select(docs.columns)
    if how != "span":
        raise ValueError(f"how must be 'document' or 'span', not {how!r}")

    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            place = rows.schema.get_field_index(text)
            out = []
            for t, h in zip(rows.column(place).to_pylist(), rows.column(rows.schema.get_field_index("_hit")).to_pylist(), strict=True):
                if t is not None and h["spans"]:
                    raw, at, kept = t.encode(), 0, []
                    for s in h["spans"]:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    t = b"".join([*kept, raw[at:]]).decode()
                out.append(t)
            yield rows.set_column(place, rows.schema.field(place), pa.array(out, rows.schema.field(place).type)).select(columns)

    return marked.mapInArrow(cut, docs.schema)
