"""Rules of the incident schema and what a document breaks of them.

The schema is data: for each field its shape and whether it must be there. The
rules become one expression over the parsed document, so validation stays in the
engine and needs no model objects. A field that is absent has its default;
fields that normalisation takes in any shape have no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import BARRIER_TYPES, FACTORS, LINES_OF_DEFENSE, SIDES, STATUSES
from .coercion import controls_of, is_array, is_object

TEXT, MAYBE_TEXT, FLAG, TEXTS = "text", "maybe text", "flag", "texts"
# Names and shapes of the fields; a trailing star marks one that must be there.
ITEM = {"name*": TEXT, "description": MAYBE_TEXT}
PERFORMANCE = {"barrier_status": STATUSES, **dict.fromkeys(["barrier_failed", *(f"{k}_{x}" for k in ("detection", "alarm", "manual_intervention") for x in ("applicable", "mentioned"))], FLAG)}
HUMAN = {"human_contribution_value": MAYBE_TEXT, "human_contribution_mentioned": FLAG, "barrier_failed_human": FLAG, "linked_pif_ids": TEXTS}
EVIDENCE = {"supporting_text": TEXTS, "confidence": ["high", "medium", "low"]}
CONTROL = {
    "control_id*": TEXT, "name": TEXT, "side": SIDES, "barrier_role": TEXT, "barrier_type": BARRIER_TYPES, "line_of_defense": LINES_OF_DEFENSE, "lod_basis": MAYBE_TEXT,
    "linked_threat_ids": TEXTS, "linked_consequence_ids": TEXTS, "performance": PERFORMANCE, "human": HUMAN, "evidence": EVIDENCE,
}
DOCUMENT = {
    "incident_id*": TEXT,
    "source": {"doc_type": TEXT, "url": MAYBE_TEXT, "title": TEXT, "date_published": MAYBE_TEXT, "date_occurred": MAYBE_TEXT, "timezone": MAYBE_TEXT},
    "context": {"region": TEXT, "operator": TEXT},
    "event": {"incident_type": TEXT, "actions_taken": TEXTS, "summary": TEXT, "recommendations": TEXTS, "key_phrases": TEXTS},
    "bowtie": {
        "hazards": [{"hazard_id*": TEXT, **ITEM}],
        "threats": [{"threat_id*": TEXT, **ITEM}],
        "consequences": [{"consequence_id*": TEXT, **ITEM, "severity": MAYBE_TEXT}],
        "controls": [CONTROL],
    },
    "pifs": {c: {k: s for f in names for k, s in ((f"{f}_value", MAYBE_TEXT), (f"{f}_mentioned", FLAG))} for c, names in FACTORS.items()},
    "notes": {"rules": TEXT, "schema_version": TEXT},
}
# The messages.
NOT_TEXT, NOT_FLAG, NOT_LIST, NOT_OBJECT, MISSING = "Input should be a valid string", "Input should be a valid boolean", "Input should be a valid list", "Input should be a valid dictionary", "Field required"
TRUTHS = ["true", "t", "yes", "y", "on", "1", "false", "f", "no", "n", "off", "0"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _not_among(allowed: list[str]) -> str:
    quoted = [f"'{a}'" for a in allowed]
    return f"Input should be {', '.join(quoted[:-1])} or {quoted[-1]}"


def _error(where: Column, message: str) -> Column:
    return F.array(F.concat(where, F.lit(": " + message)))


def _joined(lists: list[Column]) -> Column:
    return F.flatten(F.array(*lists))


def _field(v: Column, shape, where: Column, required: bool) -> Column:
    """The errors of one field of value v (null: absent); `where` names it."""
    type_, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    found = F.when(v.isNull(), _error(where, MISSING) if required else _none())
    if isinstance(shape, dict):
        return found.when(is_object(v), errors_of(v, shape, where)).otherwise(_error(where, NOT_OBJECT))
    if shape == TEXTS or isinstance(shape, list) and isinstance(shape[0], dict):
        at = lambda i: F.concat(where, F.lit(" -> "), i.cast("string"))
        if shape == TEXTS:
            each = lambda x, i: F.when(F.schema_of_variant(x) == "STRING", _none()).otherwise(_error(at(i), NOT_TEXT))
        else:
            each = lambda x, i: F.when(is_object(x), errors_of(x, shape[0], at(i))).otherwise(_error(at(i), NOT_OBJECT))
        return found.when(is_array(v), F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), each))).otherwise(_error(where, NOT_LIST))
    if isinstance(shape, list):
        return found.when((type_ == "STRING") & text.isin(shape), _none()).otherwise(_error(where, _not_among(shape)))
    if shape == FLAG:
        good = (type_ == "BOOLEAN") | ((type_ == "BIGINT") & text.isin("0", "1")) | ((type_ == "STRING") & F.lower(text).isin(TRUTHS))
        return found.when(good, _none()).when(type_.isin("STRING", "BIGINT"), _error(where, NOT_FLAG + ", unable to interpret input")).otherwise(_error(where, NOT_FLAG))
    return found.when(type_.isin("STRING", *(["VOID"] if shape == MAYBE_TEXT else [])), _none()).otherwise(_error(where, NOT_TEXT))


def errors_of(v: Column, shapes: dict, where: Column | None = None) -> Column:
    """All errors of an object, in the order of its fields; a list of `place -> place: message`.

    One cast opens the object and a lambda names its fields, so that each is
    built once however often it is asked about, and what is absent costs a test
    for null.
    """
    names = {name: name.rstrip("*") for name in shapes}
    place = lambda plain: F.lit(plain) if where is None else F.concat(where, F.lit(f" -> {plain}"))
    opened = F.try_variant_get(v, "$", f"struct<{','.join(f'`{plain}`:variant' for plain in names.values())}>")
    return F.transform(F.array(opened), lambda o: _joined([_field(o[names[n]], shape, place(names[n]), n.endswith("*")) for n, shape in shapes.items()]))[0]


def document_errors(v: Column) -> Column:
    """The errors of a parsed document (null: not JSON). Controls at the top of a document without others count as its own."""
    inside = {k: s for k, s in DOCUMENT.items() if k != "bowtie"} | {"bowtie": {k: s for k, s in DOCUMENT["bowtie"].items() if k != "controls"}}
    at = lambda i: F.concat(F.lit("bowtie -> controls -> "), i.cast("string"))
    each = F.transform(controls_of(v), lambda c, i: F.when(c.isNull(), _none()).when(is_object(c), errors_of(c, CONTROL, at(i))).otherwise(_error(at(i), NOT_OBJECT)))
    controls = "$.bowtie.controls"
    shape = F.when(is_array(v, controls) | F.try_variant_get(v, controls, "variant").isNull(), _none()).otherwise(_error(F.lit("bowtie -> controls"), NOT_LIST))
    found = _joined([errors_of(v, inside), shape, F.flatten(each)])
    return F.when(v.isNull(), F.array(F.lit("document: not JSON"))).when(is_object(v), found).otherwise(F.array(F.lit(f"document: {NOT_OBJECT}")))


def validation_errors(parsed: DataFrame) -> DataFrame:
    """(incident_id, error) of each rule that a document breaks."""
    return parsed.select("incident_id", F.explode(document_errors(F.col("v"))).alias("error"))


def validity(parsed: DataFrame) -> DataFrame:
    """(incident_id, valid, errors): errors joined by '; '."""
    found = parsed.select("incident_id", document_errors(F.col("v")).alias("e"))
    return found.select("incident_id", (F.size("e") == 0).alias("valid"), F.array_join("e", "; ").alias("errors"))
