"""The fixed schema of an incident document and of manifests."""

from __future__ import annotations

from pyspark.sql import types as T

from .functions.vocabulary import FACTORS

S, B, L = T.StringType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_strings = T.ArrayType(S)
CONTROL = _struct(
    control_id=S, name=S, side=S, barrier_role=S, barrier_type=S, line_of_defense=S, lod_basis=S, linked_threat_ids=_strings, linked_consequence_ids=_strings,
    performance=_struct(barrier_status=S, barrier_failed=B),
    human=_struct(human_contribution_value=S, human_contribution_mentioned=B, barrier_failed_human=B, linked_pif_ids=_strings),
    evidence=_struct(supporting_text=_strings, confidence=S),
)
INCIDENT = _struct(
    incident_id=S,
    source=_struct(agency=S, doc_type=S, url=S, title=S, date_published=S, date_occurred=S, timezone=S),
    context=_struct(region=S, operator=S, operating_phase=S, materials=_strings),
    event=_struct(top_event=S, incident_type=S, costs=S, summary=S, actions_taken=_strings, recommendations=_strings, key_phrases=_strings),
    bowtie=_struct(
        hazards=T.ArrayType(_struct(hazard_id=S, name=S, description=S)),
        threats=T.ArrayType(_struct(threat_id=S, name=S, description=S)),
        consequences=T.ArrayType(_struct(consequence_id=S, name=S, description=S, severity=S)),
        controls=T.ArrayType(CONTROL),
    ),
    pifs=_struct(**{c: _struct(**{k: t for f in names for k, t in ((f"{f}_value", S), (f"{f}_mentioned", B))}) for c, names in FACTORS.items()}),
    notes=_struct(rules=S, schema_version=S),
)
MANIFEST = _struct(
    source=S, incident_id=S, title=S, date_occurred=S, date_report_released=S, detail_url=S, pdf_url=S, pdf_path=S, downloaded=B,
    retrieved_at=T.TimestampType(), http_status=T.IntegerType(), content_type=S, file_size_bytes=L, sha256=S, error=S,
)
EXTRACTION = _struct(doc_id=S, pdf_path=S, text_path=S, extractor_used=S, text_len=T.IntegerType(), alpha_ratio=T.DoubleType(), cid_ratio=T.DoubleType(), whitespace_ratio=T.DoubleType(), lang_guess=S, extraction_status=S, fail_reason=S, extracted_at=S)
