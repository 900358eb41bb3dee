"""Text functions as column expressions; Arrow-batched UDFs only where Spark has no builtin."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Which words neither begin nor end a name, and which are too general to merge names by.
ARTICLES = ("the", "a", "an")
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ltd", "limited", "plc", "gmbh", "ag", "nv", "sa", "lp", "llp")
GENERIC = (
    "board", "project", "program", "programme", "spacecraft", "team", "contractor", "subcontractor", "mission",
    "lander", "orbiter", "probe", "vehicle", "system", "subsystem", "component", "instrument", "software",
    "hardware", "report", "panel", "committee", "review", "office", "agency", "center", "centre", "group",
    "laboratory", "lab", "management", "engineering", "operations", "staff", "project office", "project team",
    "review board", "investigation board", "mishap investigation board", "principal investigator", "root cause",
    "launch vehicle", "ground system", "flight software",
)
ID_CHARS = 72
#: Seconds before a second attempt, and at most.
BACKOFF, BACKOFF_CAP = 2.0, 60.0

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def spaced(text: Column) -> Column:
    """White space, Unicode's included, as single spaces, none at either end."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def stripped(text: Column) -> Column:
    """Text without white space, Unicode's included, at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map({t: t.casefold() for t in text.dropna().unique()})


def snake(phrase: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(casefold(phrase), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _key(name: str) -> str:
    apart = ("-", "_", "/", "\\", *map(chr, range(0x2010, 0x2016)))
    plain = "".join(" " if c in apart else c for c in folded(name))
    words = "".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in plain).split()
    low = next((i for i, w in enumerate(words) if w not in ARTICLES), len(words))
    high = next((i for i in range(len(words), low, -1) if words[i - 1] not in SUFFIXES), low)
    return " ".join(words[low:high])


@F.pandas_udf(StringType())
def name_key(name: pd.Series) -> pd.Series:
    """What two names must share to be the same entity; distinct names of a batch are worked out once."""
    return name.map({n: _key(n) for n in name.dropna().unique()})


@lru_cache
def _digits() -> str:
    """A pattern's class of the characters that Unicode counts as digits: decimal ones and single signs for them."""
    others = (c for c in range(0x110000) if chr(c).isdigit() and not chr(c).isdecimal())
    return r"\p{Nd}" + "".join(f"\\x{{{c:x}}}" for c in others)


def mergeable(key: Column) -> Column:
    """Whether a key is specific enough to join mentions."""
    return (F.length(key) > 2) & ~key.isin(*GENERIC) & ~key.rlike(f"^[{_digits()}]+$")


def _slug(name: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in folded(name)).split()
    return "-".join(kept)[:ID_CHARS].strip("-") or "node"


@F.pandas_udf(StringType())
def slug(name: pd.Series) -> pd.Series:
    return name.map({n: _slug(n) for n in name.dropna().unique()})


def document_of(chunk_id: Column) -> Column:
    """What stands before the last colon; the whole id if there is none."""
    return F.regexp_replace(chunk_id, ":[^:]*$", "")


def contains_half(chunk: Column, quote: Column) -> Column:
    """Whether the chunk holds at least half of the quote in one stretch, white space aside.

    A stretch of h or more characters is shared exactly if some window of h characters of the quote occurs. Such a
    window holds one of the quote's consecutive blocks of half its length whole, so most pairs need those few alone.
    """
    both = F.array(F.struct(spaced(quote).alias("q"), spaced(chunk).alias("t")))  # as a lambda's variable, worked out once

    def found(s: Column) -> Column:
        n = F.length(s["q"])
        half = F.ceil(n / 2).cast("int")
        part = F.greatest(F.floor((half + 1) / 2).cast("int"), F.lit(1))
        blocks = F.sequence(F.lit(0), F.floor(n / part).cast("int") - 1)
        near = F.exists(blocks, lambda k: F.contains(s["t"], F.substring(s["q"], k * part + 1, part)))
        windows = F.sequence(F.lit(1), n - half + 1)
        return (n > 0) & near & (F.contains(s["t"], s["q"]) | F.exists(windows, lambda i: F.contains(s["t"], F.substring(s["q"], i, half))))

    return F.coalesce(F.exists(both, found), F.lit(False))


def _longest(wanted: str, text: str) -> int:
    """Length of the longest common stretch: at every start, only stretches longer than the longest so far are looked up."""
    n = 0
    for i in range(len(wanted)):
        while i + n < len(wanted) and wanted[i : i + n + 1] in text:
            n += 1
    return n


@F.pandas_udf(IntegerType())
def longest_run(quote: pd.Series, chunk: pd.Series) -> pd.Series:
    """Characters of the quote's longest stretch in the chunk, white space aside; 0 for nulls."""
    return pd.Series([0 if q is None or c is None else _longest(" ".join(q.split()), " ".join(c.split())) for q, c in zip(quote, chunk, strict=True)])


def held(quote: Column, chunk: Column) -> Column:
    """The share of the quote that the chunk holds in one stretch."""
    n = F.length(spaced(quote))
    return F.when(n > 0, longest_run(quote, chunk) / n).otherwise(F.lit(0.0))


def span_on_page(page: Column, quote: Column) -> Column:
    """Start (0-based) and end of a quote on a page, white space aside; null if absent."""
    at = F.instr(spaced(page), spaced(quote))
    return F.when((at > 0) & (F.length(spaced(quote)) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(spaced(quote))).alias("end")))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans share over half of the shorter one."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return shared * 2 > F.least(a_end - a_start, b_end - b_start)


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("page %d", first)).otherwise(F.format_string("pages %d-%d", first, last))


def masked(text: Column, secret: str = r"(?i)(bearer\s+|token[=:]\s*|key[=:]\s*)[A-Za-z0-9._-]{8,}") -> Column:
    """Secrets behind their label replaced by stars."""
    return F.regexp_replace(text, secret, "$1***")


def backoff(attempt: Column, retry_after: Column, base: float = BACKOFF, cap: float = BACKOFF_CAP) -> Column:
    """Seconds before the next attempt: what the service asks, else doubling, up to a cap."""
    return F.least(F.lit(cap), F.coalesce(F.when(retry_after.isNotNull(), F.greatest(retry_after.cast("double"), F.lit(0.0))), F.lit(base) * F.pow(F.lit(2.0), attempt - 1)))
