"""JSON, JSON arrays and NDJSON as tables of raw records: (index from 1, raw, error)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.errors import Invalid, UnsupportedFormat
from sluice.operators.once import once

#: Accepted media types.
MEDIA = {"application/json": "json", "text/json": "json", "application/x-ndjson": "ndjson", "application/ndjson": "ndjson", "application/jsonl": "ndjson"}
MAX_LINE = 10 << 20
SNIFF = 512


def resolve_format(*declared: str) -> str:
    """All declared content types must agree on one format."""
    kinds = {MEDIA.get(d.split(";")[0].strip().lower()) for d in declared}
    if len(kinds) != 1 or None in kinds:
        raise UnsupportedFormat(f"content type {declared!r}")
    return kinds.pop()


def is_array(body: str) -> bool:
    return body[:SNIFF].lstrip().startswith("[")


def is_object(raw):
    """A whole JSON object, by Spark's own parser."""
    return F.try_parse_json(raw).isNotNull() & F.trim(F.regexp_replace(raw, r"^[\s﻿]+", "")).startswith("{")


def last_members(raw):
    """The record itself; one whose keys repeat with only the last of each, as readers of JSON take it."""
    members = F.from_json(raw, "map<string,variant>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    keys, values = F.map_keys(members), F.map_values(members)
    last = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(values, -F.array_position(F.reverse(keys), k).cast("int")).alias("value")))
    twins = F.size(keys) > F.size(F.array_distinct(keys))
    return F.when(F.try_parse_json(raw).isNull() & twins, F.to_json(F.map_from_entries(last))).otherwise(raw)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``index`` from 1 in the order they are read: counted by partition, then shifted by the counts before."""
    own = lines.withColumn("_at", F.monotonically_increasing_id())  # partition number and place in it
    part = F.shiftright("_at", 33)
    counts = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return own.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def ndjson(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """Lines of text (with a column that orders them) to records; blank lines are skipped, bad ones are errors."""
    raw = F.col(line)
    kept = lines.filter(F.trim(raw) != "")
    kept = kept.withColumn("index", F.col(order)) if order else numbered(kept)
    return checked(kept.select(F.col("index").cast("long").alias("index"), raw.alias("raw")), "invalid json")


def checked(records: DataFrame, fault: str) -> DataFrame:
    fits = once(records, {"_raw": F.when(F.length("raw") <= MAX_LINE, last_members(F.col("raw")))}, ["index", "raw"])
    error = F.when(F.col("_raw").isNull(), "line too long").when(~is_object(F.col("_raw")), fault)
    return fits.select("index", F.coalesce("_raw", "raw").alias("raw"), error.alias("error"))


def body(spark: SparkSession, text: str, fmt: str = "json") -> DataFrame:
    """A request's body: one object, an array or NDJSON; bounded by the request, so it may pass through the driver."""
    if fmt == "ndjson":
        rows = [(i + 1, x) for i, x in enumerate(t for t in text.split("\n") if t.strip())]
        return ndjson(spark.createDataFrame(rows, "i long, value string"), "value", "i")
    one = spark.createDataFrame([(text,)], "value string")
    if not is_array(text):
        return checked(one.select(F.lit(1).cast("long").alias("index"), F.col("value").alias("raw")), "invalid json")
    return checked(spark.createDataFrame(list(enumerate(elements(text), 1)), "index long, raw string"), "record must be a JSON object")


def elements(text: str) -> list[str]:
    """The elements of an array as they are written."""
    reader, out, at = json.JSONDecoder(parse_float=str, parse_int=str), [], text.index("[") + 1
    skip = lambda k: json.decoder.WHITESPACE.match(text, k).end()
    at = skip(at)
    while text[at : at + 1] != "]":
        try:
            end = reader.raw_decode(text, at)[1]
        except ValueError as e:
            raise Invalid(f"invalid json: {e}") from None
        out.append(text[at:end])
        at = skip(end)
        if text[at : at + 1] == ",":
            at = skip(at + 1)
        elif text[at : at + 1] != "]":
            raise Invalid("unterminated array")
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON files of any size, read in parallel."""
    return spark.read.text(path)
