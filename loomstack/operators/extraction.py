"""Extraction runtime: a model behind an interface, run over chunks in partitions, resumable, with failed rows as rows.

A call that fails in passing is tried again after a wait that doubles, or that the service asks for; any other failure,
and an answer of the wrong shape, is a `failed` record at once.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstack.functions.text import BACKOFF, BACKOFF_CAP, page_label
from loomstack.operators.resolution import ENTITY_TYPES
from loomstack.sources.readers import ENTITY, RELATION, todo
from loomstack.sources.sinks import append

RECORD = f"chunk string, model string, backend string, status string, stop_reason string, extraction struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>, usage map<string,long>, repairs map<string,long>, error string, seq long"


class Passing(Exception):
    """A failure that may pass: the call is tried again, after as many seconds as the service asked for, if it did."""

    def __init__(self, message: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class Extractor(Protocol):
    """A model: name, backend, and a call that returns (extraction, stop_reason, usage) for a prompt, or raises; Passing if it may be tried again."""

    name: str
    backend: str

    def __call__(self, prompt: str) -> tuple[dict, str, dict]: ...


class DryRun:
    """Extracts nothing; for checking a run's size and prompts."""

    name, backend = "none", "dry-run"

    def __call__(self, prompt: str) -> tuple[dict, str, dict]:
        return {"entities": [], "relations": []}, "dry-run", {"prompt_chars": len(prompt)}


def prompts(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """id, prompt: a passage with its document's title and pages."""
    rows = chunks.join(titles.select(F.col("slug").alias("document"), "title"), "document", "left")
    return rows.select("id", F.format_string("%s, %s\n\n%s", F.coalesce("title", "document"), page_label(F.col("page_start"), F.col("page_end")), "text").alias("prompt"))


def wait(attempt: int, retry_after: float | None = None) -> float:
    """Seconds before the next attempt."""
    return min(BACKOFF_CAP, max(0.0, retry_after) if retry_after is not None else BACKOFF * 2 ** (attempt - 1))


def shaped(answer: Any) -> dict:
    """An answer with the schema's keys alone and text in every field; what is no object stays away from its list, as null. Raises if it is none itself."""
    if not isinstance(answer, dict):
        raise TypeError("the answer is no object")
    text = lambda v: None if v is None else str(v)
    out: dict[str, list] = {}
    for name, keys in FIELDS.items():
        if not isinstance(own := answer.get(name) or [], list):
            raise TypeError(f"{name} is no list")
        out[name] = [{k: text(x.get(k)) for k in keys} if isinstance(x, dict) else None for x in own]
        for row, x in zip(out[name], own, strict=True):
            if row is not None and name == "entities":
                aliases = x.get("aliases") or []
                row["aliases"] = [str(v) for v in aliases if v is not None] if isinstance(aliases, list) else [str(aliases)]
    return out


#: The text fields of what a model lists; entities have aliases as well.
FIELDS = {"entities": ("name", "type", "description"), "relations": ("source", "target", "relation", "evidence")}


def repairs(found: dict) -> dict[str, int]:
    """How often the repairs that resolution makes will be needed: entities and relations dropped, repeated or given another type."""
    count, known = Counter(), set()
    fold = lambda v: (v or "").strip().casefold()
    for e in found["entities"]:
        name = fold(e and e["name"])
        if not name or name in known:
            count["duplicate_entities" if name else "dropped_entities"] += 1
            continue
        known.add(name)
        count["retyped_entities"] += fold(e["type"]) not in ENTITY_TYPES
    for r in found["relations"]:
        ends = {fold(r["source"]), fold(r["target"])} if r else set()
        said = any(c.isascii() and c.isalnum() for c in fold(r and r["relation"]))
        count["dropped_relations"] += len(ends & known) < 2 or not said
    return {k: n for k, n in count.items() if n}


def extract(rows: DataFrame, extractor: Extractor, attempts: int = 5, seq: int = 0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Records of prompts (id, prompt), with the repairs that they need."""

    def one(prompt: str) -> tuple:
        for attempt in range(1, attempts + 1):
            try:
                answer, stop, usage = extractor(prompt)
                found = shaped(answer)
                status = "dry-run" if extractor.backend == "dry-run" else "truncated" if stop == "max_tokens" else "ok"
                return status, stop, found, {k: v for k, v in usage.items() if type(v) is int}, repairs(found), None
            except Passing as problem:
                error = str(problem) or type(problem).__name__
                if attempt < attempts:
                    sleep(wait(attempt, problem.retry_after))
            except Exception as problem:  # noqa: BLE001 - any failure of a model is a record, not a lost task
                return "failed", None, None, {}, {}, str(problem) or type(problem).__name__
        return "failed", None, None, {}, {}, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(chunk, extractor.name, extractor.backend, *one(prompt), seq) for chunk, prompt in zip(pdf["id"], pdf["prompt"], strict=True)]
            yield pd.DataFrame(out, columns=["chunk", "model", "backend", "status", "stop_reason", "extraction", "usage", "repairs", "error", "seq"])

    return rows.mapInPandas(run, RECORD)


def run_in_batches(chunks: DataFrame, titles: DataFrame, extractor: Extractor, path: str, batches: int = 1, breaker: float = 0.5) -> int:
    """Extracts what path's log still lacks, a batch at a time; stops, resumable, when over `breaker` of a batch failed. Returns batches run."""
    spark = chunks.sparkSession
    for batch in range(batches):
        own = prompts(chunks, titles).filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch)
        try:
            log = spark.read.schema(RECORD).json(path)
            seq = log.agg(F.max("seq")).first()[0] or 0
            own = todo(own, log)
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            seq = 0
        append(extract(own, extractor, seq=seq + 1), path)
        now = spark.read.schema(RECORD).json(path).filter(F.col("seq") == seq + 1)
        share = now.agg(F.avg((F.col("status") == "failed").cast("int"))).first()[0] or 0.0
        if share > breaker:
            return batch + 1
    return batches


def run_counters(records: DataFrame) -> DataFrame:
    """counter, n: sums of the usage and repair maps and of statuses."""
    status = records.select(F.concat(F.lit("status."), F.coalesce("status", F.lit("ok"))).alias("counter"), F.lit(1).cast("long").alias("v"))
    maps = [records.select(F.explode(F.col(c)).alias("k", "v")).select(F.concat(F.lit(f"{c}."), "k").alias("counter"), "v") for c in ("usage", "repairs")]
    return status.unionByName(maps[0]).unionByName(maps[1]).groupBy("counter").agg(F.sum("v").alias("n"))
