"""Records -> outcomes and storable rows, in one pass of Column expressions.

Order for each record: readable, valid against the schema, allowed columns, checks (or
injected values), canonical timestamps, duplicate ids.  The first fault is the outcome.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.catalog import Table
from sluice.functions import canonical, timestamps
from sluice.operators.aggregates import col
from sluice.operators.once import once
from sluice.policy import WriteGrant

MAX_RESULTS = 10_000


@dataclass(frozen=True)
class Dedupe:
    id_field: str = ""
    require_id: bool = False


def kind(t: Column) -> Column:
    """JSON kind of a variant, from its type's text."""
    return F.when(t.isNull() | t.isin("VOID"), "null").when(t == "STRING", "string").when(t == "BOOLEAN", "bool").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")


def first(*faults: tuple[Column, Column | str]) -> Column:
    out = F.lit(None).cast("string")
    for test, text in reversed(faults):
        out = F.when(test, text if isinstance(text, Column) else F.lit(text)).otherwise(out)
    return out


#: A stretch without numbers (whole strings included), then a number.
BEFORE_NUMBER = r'\G((?:[^"\-0-9]++|"(?:[^"\\]++|\\.)*+")*+)(-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)'


def quoted_numbers(raw: Column) -> Column:
    """JSON with its numbers as strings: Spark's reader would pass them through doubles."""
    return F.regexp_replace(raw, BEFORE_NUMBER, '$1"$2"')


def field(name: str) -> Column:
    """A top-level member's text exactly as it came, numbers with all their digits; null if absent or null."""
    plain = F.element_at(F.col("_plain"), name)
    return F.when(plain.rlike(r"^[\[{]"), plain).otherwise(F.element_at(F.col("_map"), name))


def prepare(records: DataFrame, table: Table, grant: WriteGrant, dedupe: Dedupe = Dedupe()) -> DataFrame:
    """records (index, raw, error) -> (index, status, reason, id, one text column for each insertable column)."""
    checks = grant.checks(table)
    good = F.col("error").isNull()
    df = once(records, {"_v": F.when(good, F.try_parse_json("raw")), "_map": F.when(good, F.from_json(quoted_numbers(F.col("raw")), "map<string,string>")), "_plain": F.when(good, F.from_json("raw", "map<string,string>"))})
    typed_ = [k for k, c in enumerate(table.insertable) if c.type.json or c.type.kind == "time"]  # of others the kind decides nothing
    member = lambda c: F.try_variant_get("_v", "$['" + c.name.replace("'", "\\'") + "']", "variant")
    df = once(df, {f"_t{k}": field(c.name) for k, c in enumerate(table.insertable)} | {f"_k{k}": F.schema_of_variant(member(table.insertable[k])) for k in typed_})
    df = df.drop("_v", "_plain") if not dedupe.id_field or dedupe.id_field in [c.name for c in table.insertable] else df
    texts = {c.name: F.col(f"_t{k}") for k, c in enumerate(table.insertable)}
    kinds = {table.insertable[k].name: kind(F.col(f"_k{k}")) for k in typed_}
    df = df.withColumn("_keys", F.coalesce(F.map_keys("_map"), F.array().cast("array<string>")))
    faults = [(F.col("error").isNotNull(), F.col("error"))]
    unknown = F.array_except("_keys", F.array(*(F.lit(c) for c in table.names)))
    faults.append((F.size(unknown) > 0, F.concat(F.lit("unknown column "), F.element_at(unknown, 1))))
    for c in table.columns:
        has = F.array_contains("_keys", c.name)
        if not c.insertable:
            faults.append((has, f"computed column {c.name}"))
            continue
        if c.required:  # validated before checks, which inject only what may be absent
            faults.append((~has, f"missing required column {c.name}"))
        if not c.type.nullable and c.default_kind == "":
            faults.append((has & texts[c.name].isNull(), f"null in column {c.name}"))
        if c.type.json:
            faults.append((texts[c.name].isNotNull() & ~kinds[c.name].isin(*sorted(c.type.json)), f"wrong type for column {c.name}"))
    if grant.insert is not None:
        denied = F.array_except("_keys", F.array(*(F.lit(c) for c in table.names if grant.column(c))))
        faults.append((F.size(denied) > 0, F.concat(F.lit("column not allowed "), F.element_at(denied, 1))))
    stored = dict(texts)
    for name, (op, values) in checks.items():
        has, text = F.array_contains("_keys", name), texts[name]
        numbers = [n for v in values if (n := canonical.numeric(v)) is not None]
        same = F.coalesce(text.isin(*values) if values else F.lit(False), F.lit(False))
        if numbers:
            same = same | F.coalesce(canonical.numeric_column(text).isin(*numbers), F.lit(False))
        faults.append(((has if op == "eq" else F.lit(True)) & ~same, f"check failed for column {name}"))
        if op == "eq":
            stored[name] = F.when(has, text).otherwise(F.lit(values[0]))
    for c in table.insertable:
        if c.type.kind == "time":
            stored[c.name] = timestamps.canonical_column(stored[c.name], c.type, kinds[c.name] == "number")
    rid = (texts[dedupe.id_field] if dedupe.id_field in texts else field(dedupe.id_field)) if dedupe.id_field else F.lit(None).cast("string")
    if dedupe.id_field and dedupe.require_id:
        faults.append((rid.isNull(), f"missing id {dedupe.id_field}"))
    out = once(df, {"reason": first(*faults), "id": rid} | {f"c_{n}": v for n, v in stored.items()}, ["index"])
    if dedupe.id_field:
        good = F.col("reason").isNull() & F.col("id").isNotNull()
        # the first row of each id, by an aggregate that is partial in every task: a frequent id is no hot task
        firsts = out.filter(good).groupBy("id").agg(F.min("index").alias("_first"))
        out = out.join(firsts.withColumnRenamed("id", "_id"), good & (F.col("id") == F.col("_id")), "left")
        out = out.withColumn("status", F.when(F.col("reason").isNotNull(), "error").when(good & (F.col("index") > F.col("_first")), "duplicate").otherwise("ok"))
    else:
        out = out.withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("error"))
    return out.select("index", "status", "reason", "id", *(F.col(f"`c_{n}`").alias(n) if n not in ("index", "status", "reason", "id") else F.col(f"`c_{n}`").alias(f"c_{n}") for n in stored))


def against_seen(prepared: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Mark ids that an earlier request stored and that haven't expired; seen (id, expires_at null: never)."""
    live = seen.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("id").distinct().withColumn("_seen", F.lit(True))
    return prepared.join(live, "id", "left").withColumn("status", F.when(F.col("_seen") & (F.col("status") == "ok"), "duplicate").otherwise(F.col("status"))).drop("_seen")


def remember(prepared: DataFrame, path: str, retention_seconds: int = 0) -> None:
    """Add the ids that were stored to the seen table; without a retention they never expire."""
    until = F.current_timestamp() + F.make_dt_interval(secs=F.lit(retention_seconds)) if retention_seconds > 0 else F.lit(None).cast("timestamp")
    prepared.filter((F.col("status") == "ok") & F.col("id").isNotNull()).select("id", until.alias("expires_at")).write.mode("append").parquet(path)


def purge_seen(seen: DataFrame, now: Column) -> DataFrame:
    """What a sweep of the seen table keeps: one row for each id that still counts."""
    live = seen.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    never = F.bool_or(F.col("expires_at").isNull())
    return live.groupBy("id").agg(F.max("expires_at").alias("last"), never.alias("never")).select("id", F.when(~F.col("never"), F.col("last")).alias("expires_at"))


def outcomes(prepared: DataFrame) -> DataFrame:
    return prepared.select("index", "status", "reason")


def response(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a caller gets: the first MAX_RESULTS outcomes in order, and the totals of all."""
    return outcomes(prepared).orderBy("index").limit(MAX_RESULTS), totals(prepared)


def totals(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("status").agg(F.count("*").alias("n"))


def typed(rows: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """Storable rows and rejected ones, without a retry loop: a text its column's type can't read rejects the row.

    Absent values take the column's default; computed columns are filled in; ALIAS columns are read-time.
    """
    cast, faults = {}, F.array().cast("array<string>")
    for c in table.insertable:
        text = col(c.name)
        value = timestamps.parse_column(text, c.type) if c.type.kind == "time" else canonical.truncate(text.try_cast("decimal(38,18)"), c.type.precision, c.type.scale) if c.type.kind == "decimal" and c.type.precision <= 38 else F.from_json(text, c.type.spark.simpleString()) if c.type.spark.typeName() in ("array", "map") else text.try_cast(c.type.spark)
        if c.type.kind == "integer" and c.type.low is not None and abs(c.type.low) < 10**19 and c.type.high < 10**19:
            value = F.when(value.between(c.type.low, c.type.high), value)
        faults = F.array_append(faults, F.when(text.isNotNull() & value.isNull(), F.lit(c.name)))
        default = F.expr(c.default) if c.default and c.default_kind in ("DEFAULT", "EPHEMERAL") else None
        cast[c.name] = F.coalesce(value, default.cast(value_type(c))) if default is not None else value
    marked = once(rows, {"_bad": F.array_compact(faults)} | {f"_s_{n}": v for n, v in cast.items()})
    bad = marked.filter(F.size("_bad") > 0).select(F.to_json(F.struct(*(col(c.name) for c in table.insertable))).alias("payload"), F.concat(F.lit("cannot store "), F.concat_ws(", ", "_bad")).alias("error"))
    good = marked.filter(F.size("_bad") == 0).select(*(col(f"_s_{n}").alias(n) for n in cast))
    for c in table.columns:
        if c.default_kind == "MATERIALIZED":
            good = good.withColumn(c.name, F.expr(c.default))
    good = good.drop(*(c.name for c in table.columns if c.default_kind == "EPHEMERAL"))
    return good, bad


def value_type(c) -> str:
    return c.type.spark.simpleString()


def with_aliases(df: DataFrame, table: Table) -> DataFrame:
    for c in table.columns:
        if c.default_kind == "ALIAS":
            df = df.withColumn(c.name, F.expr(c.default))
    return df
