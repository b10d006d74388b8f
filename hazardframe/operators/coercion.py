"""Incident JSON of drifting shape: coercion, counters, validation, tolerant parsing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocabulary import FACTORS, LINES_OF_DEFENSE, LOD_NUMBERS, SIDE_SYNONYMS, STATUS_SYNONYMS, STATUSES
from .metrics import percentiles


def _mapped(value: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, F.coalesce(value, F.lit("")))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def text_of(v: Column, path: str) -> Column:
    """The value at a path as text: a list joined by '; ', anything else as it prints, null if missing."""
    items = F.try_variant_get(v, path, "array<string>")
    return F.when(items.isNotNull(), F.array_join(items, "; ")).otherwise(_text(v, path))


def list_of(v: Column, path: str) -> Column:
    """The value at a path as a list of text: a scalar becomes a list of one, missing an empty list."""
    items = F.try_variant_get(v, path, "array<string>")
    one = F.nullif(F.trim(_text(v, path)), F.lit(""))
    return F.when(items.isNotNull(), F.filter(items, lambda x: x.isNotNull())).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def kind(v: Column, path: str) -> Column:
    """What stands at a path: VOID for JSON null, BIGINT, STRING, ARRAY<..>, OBJECT<..>; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_object(v: Column, path: str = "$") -> Column:
    """Whether an object stands at a path; unlike its kind, this does not look at what it holds."""
    return F.try_variant_get(v, path, "struct<>").isNotNull()


def is_array(v: Column, path: str = "$") -> Column:
    """Whether a list stands at a path; its items are not built."""
    return F.try_variant_get(v, path, "array<boolean>").isNotNull()


def side(raw: Column) -> Column:
    return F.coalesce(_mapped(F.lower(F.trim(raw)), SIDE_SYNONYMS), F.lit("prevention"))


def line_of_defense(raw: Column, type_: Column | None = None) -> Column:
    """Whole numbers by their order; text that is a name of a line as it is; all else unknown. type_: the JSON kind, text if not given."""
    number = F.try_element_at(F.create_map(*[F.lit(x) for pair in LOD_NUMBERS.items() for x in pair]), F.regexp_replace(F.trim(raw), r"^0+(?=\d)", ""))
    text = F.when(F.trim(raw).rlike(r"^\d+$"), number).when(F.trim(raw).isin(LINES_OF_DEFENSE), raw)
    if type_ is None:
        return F.coalesce(text, F.lit("unknown"))
    whole = F.when(type_ == "BIGINT", number).when(type_ == "BOOLEAN", F.when(raw == "true", LOD_NUMBERS["1"]))
    return F.coalesce(F.when(type_ == "STRING", text).otherwise(whole), F.lit("unknown"))


def status(raw: Column) -> Column:
    clean = F.lower(F.trim(raw))
    return F.coalesce(F.when(clean.isin(STATUSES), clean), _mapped(clean, STATUS_SYNONYMS), F.lit("unknown"))


def parse(texts: DataFrame, column: str = "payload") -> DataFrame:
    """`column` as a variant named v; what is not JSON, once a byte order mark is off, is null."""
    return texts.withColumn("v", F.try_parse_json(F.regexp_replace(column, r"^\x{FEFF}", "")))


def controls_of(v: Column) -> Column:
    """The controls where they belong, or those that stand at the top of a document that has none there."""
    inside = F.try_variant_get(v, "$.bowtie.controls", "array<variant>")
    some = F.size(F.try_variant_get(v, "$.bowtie.controls", "array<boolean>")) > 0  # counted without building them
    return F.coalesce(F.when(some, inside), F.try_variant_get(v, "$.controls", "array<variant>"), F.array().cast("array<variant>"))


def _is(type_: Column, *names: str) -> Column:
    """Whether a JSON kind is one of these; null (nothing there) is none."""
    hit = F.lit(False)
    for n in names:
        hit = hit | F.coalesce(type_.startswith(n), F.lit(False))
    return hit


def coerced_control(c: Column) -> dict[str, Column]:
    """The values of one control after coercion."""
    human, raw_status = kind(c, "$.human.human_contribution_value"), F.when(_is(kind(c, "$.performance.barrier_status"), "STRING"), _text(c, "$.performance.barrier_status"))
    told = F.when(human.isNull() | _is(human, "VOID"), "unknown").otherwise(text_of(c, "$.human.human_contribution_value"))
    return {
        "control_id": _text(c, "$.control_id"),
        "side": side(_text(c, "$.side")),
        "line_of_defense": line_of_defense(_text(c, "$.line_of_defense"), kind(c, "$.line_of_defense")),
        "barrier_status": status(raw_status),
        "human_contribution_value": F.when(_is(kind(c, "$.human"), "OBJECT"), told),
    }


def control_coercions(c: Column) -> list[tuple[str, Column]]:
    """(name, whether it was applied) of every coercion of one control."""
    raw_side, lod, line = _text(c, "$.side"), _text(c, "$.line_of_defense"), kind(c, "$.line_of_defense")
    mapped, digits = _mapped(F.lower(F.trim(raw_side)), SIDE_SYNONYMS), F.trim(lod).rlike(r"^\d+$")
    state, stated = kind(c, "$.performance.barrier_status"), F.lower(F.trim(_text(c, "$.performance.barrier_status")))
    synonym = _mapped(stated, STATUS_SYNONYMS).isNotNull()
    human, there = kind(c, "$.human.human_contribution_value"), _is(kind(c, "$.human"), "OBJECT")
    none = human.isNull() | _is(human, "VOID")
    return [
        ("side_mapped", mapped.isNotNull() & (raw_side != mapped)),
        ("side_default_prevention", mapped.isNull()),
        ("lod_int_to_enum", _is(line, "BIGINT", "BOOLEAN")),
        ("lod_strnum_to_enum", _is(line, "STRING") & digits),
        ("lod_unknown", _is(line, "STRING") & ~digits & ~F.trim(lod).isin(LINES_OF_DEFENSE)),
        ("lod_missing", ~_is(line, "STRING", "BIGINT", "BOOLEAN")),
        ("performance_created", ~_is(kind(c, "$.performance"), "OBJECT")),
        ("barrier_status_mapped", _is(state, "STRING") & ~stated.isin(STATUSES) & synonym),
        ("barrier_status_unknown", _is(state, "STRING") & ~stated.isin(STATUSES) & ~synonym),
        ("barrier_status_missing", ~_is(state, "STRING")),
        ("human_value_none_to_unknown", there & none),
        ("human_value_list_to_str", there & _is(human, "ARRAY")),
        ("human_value_to_str", there & ~none & ~_is(human, "ARRAY", "STRING")),
    ]


def coerced_controls(parsed: DataFrame) -> DataFrame:
    """One row a control of every readable document, coerced."""
    rows = parsed.select("incident_id", F.posexplode(controls_of(F.col("v"))).alias("pos", "c")).where(F.schema_of_variant("c").startswith("OBJECT"))
    return rows.select("incident_id", F.col("pos").cast("long").alias("pos"), *[x.alias(n) for n, x in coerced_control(F.col("c")).items()])


def _named(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in checks]))


def _renamed(items: Column, name: str) -> Column:
    """One name for each item that has an id where `name` should be."""
    found = F.filter(items, lambda x: kind(x, "$.id").isNotNull() & kind(x, f"$.{name}").isNull())
    return F.transform(found, lambda x: F.lit(f"{name}_remapped"))


def coercions(v: Column) -> Column:
    """The names of all coercions that a document needs, each as often as it is applied."""
    event, kept = kind(v, "$.event"), kind(v, "$.event.incident_type")
    empty = kept.isNull() | _is(kept, "VOID") | (_is(kept, "STRING") & (F.trim(_text(v, "$.event.incident_type")) == ""))
    here = _is(event, "OBJECT")
    out = [
        _named([
            ("incident_type_list_to_str", here & _is(kept, "ARRAY")),
            ("incident_type_empty_to_unknown", here & empty),
            ("incident_type_to_str", here & ~empty & ~_is(kept, "ARRAY", "STRING")),
        ])
    ]
    for place, name in (("hazards", "hazard_id"), ("threats", "threat_id"), ("consequences", "consequence_id")):
        items = F.coalesce(F.try_variant_get(v, f"$.bowtie.{place}", "array<variant>"), F.array().cast("array<variant>"))
        out.append(_renamed(items, name))
    controls = F.filter(controls_of(v), lambda c: F.schema_of_variant(c).startswith("OBJECT"))
    out.append(F.flatten(F.transform(controls, lambda c: _named(control_coercions(c)))))
    return F.concat(*out)


def coercion_counts(parsed: DataFrame) -> DataFrame:
    """(coercion, n): how often each was applied over all readable documents, by combined sums."""
    return parsed.where("v is not null").select(F.explode(coercions(F.col("v"))).alias("coercion")).groupBy("coercion").agg(F.count("*").alias("n"))


def incident_type(v: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text_of(v, "$.event.incident_type")), F.lit("")), F.lit("unknown"))


def _first(v: Column, *paths: str) -> Column:
    """The value at the first path at which anything stands."""
    return F.coalesce(*[F.try_variant_get(v, p, "variant") for p in paths])


def _printed(v: Column, joined: str = "; ") -> Column:
    """A value as text: lists joined, objects as JSON, null for nothing or JSON null."""
    type_ = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<string>")
    return F.when(_is(type_, "VOID"), F.lit(None).cast("string")).when(_is(type_, "ARRAY"), F.array_join(items, joined)).when(_is(type_, "OBJECT"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def schema_fields(v: Column) -> dict[str, Column]:
    """The fields of a document that come in many shapes, in that of the schema, under their own or a drifted name."""
    phase, material, cost = (F.try_variant_get(v, p, "variant") for p in ("$.context.operating_phase", "$.context.materials", "$.event.costs"))
    phase_text = F.when(_is(F.schema_of_variant(phase), "OBJECT"), _printed(phase)).when(_is(F.schema_of_variant(phase), "STRING"), F.trim(F.lower(_printed(phase)))).otherwise(F.lower(_printed(phase)))
    type_ = F.schema_of_variant(material)
    values = F.filter(F.map_values(F.try_variant_get(material, "$", "map<string,string>")), lambda x: F.trim(x) != "")
    materials = F.when(_is(type_, "OBJECT"), values).when(_is(type_, "ARRAY"), F.try_variant_get(material, "$", "array<string>")).when(material.isNotNull() & ~_is(type_, "VOID"), F.array(_printed(material)))
    return {
        "operating_phase": F.coalesce(phase_text, F.lit("unknown")),
        "materials": F.coalesce(materials, F.array().cast("array<string>")),
        "top_event": F.coalesce(_printed(_first(v, "$.event.top_event", "$.event.type")), F.lit("unknown")),
        "incident_type": F.coalesce(_printed(_first(v, "$.event.incident_type", "$.event.category")), F.lit("unknown")),
        "summary": F.coalesce(_printed(_first(v, "$.event.summary", "$.event.description")), F.lit("")),
        "costs": F.when(F.schema_of_variant(cost) != "OBJECT<>", _printed(cost)),
        "n_controls": F.size(controls_of(v)).cast("long"),
    }


GATE_PARTS = ["controls", "summary", "pifs", "hazards", "threats", "consequences"]


def gate_facts(parsed: DataFrame) -> DataFrame:
    """(n_controls, has_*) of each document; all null for one that cannot be read."""
    v = F.col("v")
    n = lambda path: F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")), F.lit(0)).cast("long")
    flags = [F.coalesce(F.try_variant_get(v, f"$.pifs.{c}.{f}_mentioned", "boolean"), F.lit(False)) for c, names in FACTORS.items() for f in names]
    found = {
        "n_controls": n("$.bowtie.controls"), "has_controls": n("$.bowtie.controls") > 0, "has_summary": F.coalesce(_text(v, "$.event.summary") != "", F.lit(False)), "has_pifs": F.greatest(*flags),
        **{f"has_{p}": n(f"$.bowtie.{p}") > 0 for p in ("hazards", "threats", "consequences")},
    }
    return parsed.select("incident_id", *[F.when(v.isNotNull(), c).alias(name) for name, c in found.items()])


def quality_gate(facts: DataFrame) -> DataFrame:
    """One row: documents, count and percentage (one digit, of all documents) of each part, and least, median, 90th percentile and most controls.

    facts: n_controls (null for an unreadable document) and has_*. Percentiles
    come from counts of each number of controls, not from all documents in one task.
    """
    flags = [c for c in facts.columns if c.startswith("has_")]
    percent = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c) * F.lit(100.0), F.count("*")), 1), F.lit(0.0))
    counts = facts.agg(F.count("*").alias("documents"), *[x for c in flags for x in (F.count_if(c).alias(c), percent(c).alias(f"{c}_pct"))])
    spread = percentiles(facts.where("n_controls is not null"), "n_controls", {"p50": 0.5, "p90": 0.9})
    bounds = facts.agg(F.coalesce(F.min("n_controls"), F.lit(0)).alias("least"), F.coalesce(F.max("n_controls"), F.lit(0)).alias("most"))
    zero = spread.select(*[F.coalesce(F.round(c, 1), F.lit(0.0)).alias(c) for c in ("p50", "p90")])
    return counts.join(bounds, F.lit(True)).join(zero, F.lit(True))  # one row each


def run_report(rows: DataFrame) -> DataFrame:
    """One row: processed, valid, share (three digits). rows: errors ('; '-joined, blank for valid)."""
    valid = F.coalesce(F.col("errors"), F.lit("")) == ""
    return rows.agg(F.count("*").alias("processed"), F.count_if(valid).alias("valid"), F.coalesce(F.round(F.try_divide(F.count_if(valid), F.count("*")), 3), F.lit(0.0)).alias("valid_rate"))


def top_errors(rows: DataFrame, most: int = 10, width: int = 60) -> DataFrame:
    each = rows.select(F.explode(F.split(F.coalesce("errors", F.lit("")), "; ")).alias("e")).where("e != ''")
    return each.groupBy(F.substring("e", 1, width).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(most)


def first_json_block(text: str | None) -> str | None:
    """The first brace-balanced block that parses; strings and escapes are minded."""
    text = text or ""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for k in range(start, len(text)):
            ch = text[k]
            if quoted:
                quoted, escaped = escaped or ch != '"', not escaped and ch == "\\"
            elif ch == '"':
                quoted = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    try:
                        json.loads(text[start : k + 1])
                        return text[start : k + 1]
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def _blocks(text: pd.Series) -> pd.Series:
    return text.map(first_json_block)


def json_in_answer(answers: DataFrame, column: str) -> DataFrame:
    """json: the answer itself, or without code fences, or its first balanced block; null if none parses.

    Only answers that fail the first two reach Python.
    """
    plain = F.trim(F.regexp_replace(column, r"(?s)\A\s*```(?:json)?\s*|\s*```\s*\z", ""))
    direct = F.when(F.try_parse_json(column).isNotNull(), F.col(column)).when(F.try_parse_json(plain).isNotNull(), plain)
    tried = answers.withColumn("json", direct)
    done, rest = tried.where("json is not null"), tried.where("json is null")
    return done.unionByName(rest.withColumn("json", _blocks(F.col(column))))
