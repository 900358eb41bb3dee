"""What is wanted of services' JSON answers, as column expressions over the raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALLS = "array<struct<type:string,name:string,input:string>>"


def counters(usage: Column) -> Column:
    """map<string, long> of the fields of a JSON object that are whole numbers; empty for anything else."""
    fields = F.coalesce(F.from_json(usage, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.transform_values(F.map_filter(fields, lambda _, v: F.coalesce(v.rlike(r"^-?[0-9]{1,18}$"), F.lit(False))), lambda _, v: v.cast("long"))


def sole_key(answer: Column, path: str) -> Column:
    """The key of the object at a path, if it has just one: the model that answered, where a report lists models."""
    keys = F.json_object_keys(F.get_json_object(answer, path))
    return F.when(F.size(keys) == 1, keys[0])


def call_input(answer: Column, tool: str) -> Column:
    """The JSON object that an answer's first call of a tool was given; null if it was cut off before that."""
    calls = F.from_json(F.get_json_object(answer, "$.content"), CALLS)
    fine = F.filter(calls, lambda c: (c["type"] == "tool_use") & (c["name"] == tool) & F.json_object_keys(c["input"]).isNotNull())
    return F.get(fine, 0)["input"]
