"""Control names, barrier families and publishers (F1-F4, P4, S4 keys)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import AGENCIES, DOC_TYPE_AGENCIES, URL_AGENCIES

# Abbreviations of the domain and what they stand for.
ABBREVIATIONS = {
    "psv": "pressure safety valve",
    "prv": "pressure relief valve",
    "bop": "blowout preventer",
    "esd": "emergency shutdown",
    "esdv": "emergency shutdown valve",
    "sdv": "shutdown valve",
    "ssv": "surface safety valve",
    "scssv": "surface controlled subsurface safety valve",
    "sssv": "subsurface safety valve",
    "loto": "lockout tagout",
    "jsea": "job safety and environmental analysis",
    "jsa": "job safety analysis",
    "jha": "job hazard analysis",
    "tha": "task hazard analysis",
    "moc": "management of change",
    "ptw": "permit to work",
    "sop": "standard operating procedure",
    "ppe": "personal protective equipment",
    "scba": "self contained breathing apparatus",
    "hvac": "heating ventilation air conditioning",
    "pa": "public address",
    "lel": "lower explosive limit",
    "h2s": "hydrogen sulfide",
    "leo": "lower explosive limit alarm",
    "hse": "health safety environment",
    "api": "american petroleum institute",
    "nfpa": "national fire protection association",
    "osha": "occupational safety health administration",
    "bsee": "bureau of safety environmental enforcement",
    "rmp": "risk management plan",
    "pfd": "process flow diagram",
    "pid": "piping and instrumentation diagram",
    "sil": "safety integrity level",
    "sis": "safety instrumented system",
    "sif": "safety instrumented function",
    "dcs": "distributed control system",
    "plc": "programmable logic controller",
    "gos": "gas on surface",
    "lmrp": "lower marine riser package",
    "eds": "emergency disconnect sequence",
    "uwild": "underwater intervention and latch down",
}


def normalize_control_name(text: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """Lower case, abbreviations written out, punctuation and runs of space as one space."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")), r"\s+")
    table = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair])
    return F.trim(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " "))


@dataclass
class Taxonomy:
    """Families of each (side, type), in match order, with the keywords that are searched as substrings.

    The keyword lists are data: `load` reads them from a JSON object
    {"side/type": {"family": [keyword, ..], ..}, ..}.
    """

    quadrants: dict[tuple[str, str], dict[str, list[str]]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Taxonomy:
        """From a file in any store that the active session reads."""
        content = "".join(r[0] for r in SparkSession.active().read.text(path, wholetext=True).collect())
        return cls({tuple(k.split("/", 1)): v for k, v in json.loads(content).items()})

    def family(self, name: Column, role: Column, side: Column, barrier_type: Column) -> Column:
        """The first family with a keyword in the normalised name and role, else other_<kind>."""
        text = normalize_control_name(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(role, F.lit(""))))
        side, kind = F.lower(F.trim(side)), F.lower(F.trim(barrier_type))
        found = None
        for (s, t), families in self.quadrants.items():
            here = (side == s) & (kind == t)
            inner = None
            for family, words in families.items():
                hit = text.rlike("|".join("\\Q" + w + "\\E" for w in words))
                inner = F.when(hit, family) if inner is None else inner.when(hit, family)
            fallback = F.lit({"administrative": "other_admin"}.get(t, f"other_{t}"))
            value = fallback if inner is None else inner.otherwise(fallback)
            found = F.when(here, value) if found is None else found.when(here, value)
        other = F.concat(F.lit("other_"), F.coalesce(kind, F.lit("")))
        return other if found is None else found.otherwise(other)


def source_agency(agency: Column, doc_type: Column, url: Column, path: Column) -> Column:
    """The stated publisher, else by document type, by address, by the first known path segment, else UNKNOWN."""
    by_type = by_url = F
    for word, name in DOC_TYPE_AGENCIES:
        by_type = by_type.when(F.lower(doc_type).contains(word), F.lit(name))
    for word, name in URL_AGENCIES:
        by_url = by_url.when(F.lower(url).contains(word), F.lit(name))
    segments = F.array_intersect(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), F.array(*map(F.lit, AGENCIES)))
    return F.coalesce(F.nullif(agency, F.lit("")), by_type, by_url, F.upper(F.try_element_at(segments, F.lit(1))), F.lit("UNKNOWN"))


def side_of(side: Column) -> Column:
    """left and right as prevention and mitigation; other values as they are."""
    return F.when(side == "left", "prevention").when(side == "right", "mitigation").otherwise(side)
