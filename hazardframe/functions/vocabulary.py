"""Names and value sets of the incident schema."""

# The statuses, sides and weights that results depend on.
STATUSES = ["active", "degraded", "failed", "bypassed", "not_installed", "unknown"]
DID_NOT_PERFORM = ["failed", "degraded", "not_installed", "bypassed"]
GAP_STATUSES = ["failed", "bypassed", "not_installed", "unknown", ""]
BARRIER_TYPES = ["engineering", "administrative", "ppe", "unknown"]
LINES_OF_DEFENSE = ["1st", "2nd", "3rd", "recovery", "unknown"]
SIDES = ["prevention", "mitigation"]

# Influencing factors by category, in column order.
FACTORS = {
    "people": ["competence", "fatigue", "communication", "situational_awareness"],
    "work": ["procedures", "workload", "time_pressure", "tools_equipment"],
    "organisation": ["safety_culture", "management_of_change", "supervision", "training"],
}
PIFS = [f"pif_{name}" for names in FACTORS.values() for name in names]
#: Three factors are left out of model features.
MODEL_PIFS = [p for p in PIFS if p not in ("pif_fatigue", "pif_workload", "pif_time_pressure")]

# Status to condition, and the synonyms that normalisation accepts.
CONDITIONS = {
    "active": "effective", "worked": "effective", "degraded": "degraded", "failed": "ineffective",
    "bypassed": "ineffective", "not_installed": "ineffective", "unknown": "status_unknown",
}
SIDE_SYNONYMS = {
    "left": "prevention", "prevention": "prevention", "prevent": "prevention",
    "right": "mitigation", "mitigation": "mitigation", "mitigate": "mitigation", "recovery": "mitigation",
}
LOD_NUMBERS = {"1": "1st", "2": "2nd", "3": "3rd", "4": "recovery"}
STATUS_SYNONYMS = {
    "ok": "active", "effective": "active", "in_place": "active", "in place": "active", "installed": "active", "worked": "active",
    "partial": "degraded", "weak": "degraded", "broken": "failed", "not installed": "not_installed", "missing": "not_installed",
    "none": "unknown", "na": "unknown", "n-a": "unknown", "n/a": "unknown",
}

# Publishers by words of the document type and of the address, in the order they are tried.
AGENCIES = ["csb", "bsee", "tsb", "phmsa"]
DOC_TYPE_AGENCIES = [
    ("bsee", "BSEE"), ("accident investigation", "BSEE"), ("csb", "CSB"), ("recommendation status change", "CSB"), ("tsb", "TSB"), ("phmsa", "PHMSA"),
]
URL_AGENCIES = [("csb.gov", "CSB"), ("bsee.gov", "BSEE"), ("tsb.gc.ca", "TSB"), ("phmsa.dot.gov", "PHMSA")]
