"""Operators on small frames with the shapes and corner cases of incident data."""

import json
import re
import math

import pytest
from hazardframe.functions import html, text, vector
from hazardframe.operators import baseline, cascade, coercion, context, coverage, manifests, metrics, mining, ml, profiling, providers, retrieval, taxonomy, threats, validation
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def value(spark, column, **data):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in data.items()]).select(column.alias("x")).head()[0]


CONTROLS = "incident_id string, control_id string, name string, side string, barrier_type string, line_of_defense string, barrier_status string, barrier_failed boolean, barrier_failed_human boolean, human_contribution_value string, confidence string, supporting_text_count int"


@pytest.fixture(scope="module")
def controls(spark):
    return spark.createDataFrame(
        [
            ("A", "C-001", "valve", "prevention", "engineering", "1st", "Active ", False, False, "", "high", 2),
            ("A", "C-002", "pump", "prevention", "engineering", "2nd", "degraded", True, False, None, "low", 1),
            ("B", "C-001", "valve", "mitigation", "engineering", "1st", "failed", True, True, "slip", "HIGH", 0),
            ("B", "C-002", "plan", "mitigation", "administrative", None, None, True, False, None, None, 3),
            ("Z", None, "x", "mitigation", None, "3rd", "unknown", False, None, None, "low", None),
        ],
        CONTROLS,
    )


def test_coverage_keeps_incidents_without_controls(spark, controls):
    universe = spark.createDataFrame([("A",), ("B",), ("E",)], "incident_id string")
    got = {r.incident_id: r for r in coverage.coverage(controls, universe).collect()}
    assert sorted(got) == ["A", "B", "E"]
    assert got["A"].coverage_score == 0.75 and got["B"].coverage_score == 0.0 and got["E"].controls_total == 0 and got["E"].coverage_score == 0.0
    assert got["B"].status_blank == 1 and got["B"].high_confidence == 1 and got["A"].with_text == 2
    assert [r.incident_id for r in coverage.in_report_order(coverage.coverage(controls, universe)).collect()] == ["B", "E", "A"]


def test_gaps_and_rollups(controls):
    gap = coverage.gaps(controls.drop("confidence"))
    assert rows(gap.where("incident_id != 'Z'"), "incident_id", "control_id") == [("B", "C-001"), ("B", "C-002")]
    assert {r.confidence for r in gap.collect()} == {""} and gap.where("incident_id = 'Z'").count() == 1
    tidy = coverage.gap_rollups(gap)
    assert tidy.columns == ["rollup", "dimension", "value", "gap_count"]
    assert rows(tidy.where("dimension = 'side'"), "value", "gap_count") == [("mitigation", 3)]
    assert rows(tidy.where("dimension = 'line_of_defense'"), "value") == [("1st",), ("3rd",)]


def test_baselines(controls):
    assert rows(baseline.failure_rates(controls, "barrier_type"), "value", "failed", "total") == [("administrative", 1, 1), ("engineering", 2, 3)]
    assert baseline.failure_rates(controls, "no_such_column").count() == 0
    assert rows(baseline.cofailures(controls)) == [("plan", "valve", 1)]
    r = baseline.human_contribution(controls).head()
    assert (r.controls, r.mentioned, r.failed_human, r.failed_and_human, r.incidents) == (5, 1, 1, 1, 3)
    assert r.mentioned_share == 0.2 and r.failed_human_share == 0.2
    assert rows(baseline.status_distribution(controls), "barrier_status", "n", "share") == [("Active ", 1, 0.2), ("degraded", 1, 0.2), ("failed", 1, 0.2), ("unknown", 1, 0.2)]
    none = baseline.human_contribution(controls.limit(0)).head()
    assert none.controls == 0 and none.mentioned_share == 0.0


def test_fleet_coverage(spark):
    reference = spark.createDataFrame([("prevention", "Valve"), ("prevention", "Alarm"), ("mitigation", "Deluge"), ("mitigation", "Drill")], "side string, name string")
    present = spark.createDataFrame([("A", "prevention", "VALVE"), ("A", "prevention", "valve"), ("A", "prevention", "valve"), ("A", "mitigation", "alarm"), ("B", "mitigation", "drill")], "incident_id string, side string, name string")
    universe = spark.createDataFrame([("A",), ("B",), ("C",)], "incident_id string")
    got = {r.incident_id: (r.prevention, r.mitigation, r.overall) for r in baseline.fleet_coverage(present, reference, universe).collect()}
    # repeated names count up to the cap; a name on the other side counts for overall only
    assert got == {"A": (1.0, 0.0, 1.0), "B": (0.0, 0.5, 0.25), "C": (0.0, 0.0, 0.0)}
    assert rows(baseline.fleet_gaps(present, reference, universe).where("incident_id = 'A'"), "name") == [("Deluge",), ("Drill",)]
    means = baseline.fleet_means(baseline.fleet_coverage(present, reference, universe)).head()
    assert means.incidents == 3 and means.overall == pytest.approx(1.25 / 3)
    none = baseline.fleet_coverage(present, reference.limit(0), universe).collect()
    assert all((r.prevention, r.mitigation, r.overall) == (0.0, 0.0, 0.0) for r in none)


def test_fleet_means_of_nothing(spark):
    empty = spark.createDataFrame([], "incident_id string, prevention double, mitigation double, overall double")
    assert tuple(baseline.fleet_means(empty).head()) == (0, 0.0, 0.0, 0.0)


def test_labels_come_from_the_status(spark, controls):
    known = profiling.known(controls)
    assert known.count() == 4  # a null status is known
    got = rows(profiling.labels(known), "incident_id", "control_id", "label_barrier_failed", "label_barrier_failed_human")
    assert got == [("A", "C-001", 0, 0), ("A", "C-002", 1, 0), ("B", "C-001", 1, 1), ("B", "C-002", 0, 0)]


def test_contract(spark, controls):
    with pytest.raises(ValueError, match="unexpected"):
        profiling.contract(controls, ["incident_id"])
    with pytest.raises(ValueError, match="missing"):
        profiling.contract(controls, [*controls.columns, "absent"])
    assert profiling.contract(controls.withColumn("x_mentioned", F.lit(True)), controls.columns).columns == controls.columns


def test_p_values(spark):
    p = lambda r, n: profiling.correlation_p_value(F.lit(r).cast("double"), F.lit(n))
    cases = [(0.0, 50), (0.5, 30), (-0.5, 30), (0.01, 100_000), (0.3, 5), (0.9, 4), (0.001, 3), (0.2, 1000), (0.0005, 10_000_000), (0.02, 5_000)]

    def integral(r, n, steps=20_000):
        density = lambda u: (1 - u * u) ** ((n - 4) / 2)
        h = abs(r) / steps
        total = h / 3 * sum((1 if k in (0, steps) else 4 if k % 2 else 2) * density(k * h) for k in range(steps + 1))
        return 1 - 2 * total * math.exp(math.lgamma((n - 1) / 2) - math.lgamma(0.5) - math.lgamma(n / 2 - 1))

    found = spark.range(1).select(*[p(r, n).alias(f"c{k}") for k, (r, n) in enumerate(cases)]).head()
    assert list(found) == pytest.approx([integral(r, n) for r, n in cases], abs=1e-9)
    odd = spark.range(1).select(p(float("nan"), 9), p(1.0, 9), p(None, 9), p(0.5, 2)).head()
    assert tuple(odd) == (1.0, 0.0, 1.0, 1.0)


def test_encoding(spark, controls):
    codes = profiling.ordinal_encoding(controls.where("incident_id != 'Z'"), "line_of_defense")
    assert rows(codes) == [("1st", 0), ("2nd", 1), ("unknown", 2)]
    assert rows(profiling.encode(controls, "line_of_defense", codes), "incident_id", "line_of_defense") == [("A", 0), ("A", 1), ("B", 0), ("B", 2), ("Z", -1)]


def test_names_and_families(spark):
    norm = lambda t: value(spark, taxonomy.normalize_control_name(F.col("t")), t=t)
    assert norm("  PSV/ESD (Überdruck)  check_1 ") == "pressure safety valve emergency shutdown überdruck check_1"
    assert norm("capsv psv.") == "capsv pressure safety valve"
    known = taxonomy.Taxonomy({("prevention", "engineering"): {"first": ["valve"], "second": ["safety"]}, ("mitigation", "administrative"): {}})
    family = lambda n, s, t: value(spark, known.family(F.col("n"), F.lit(""), F.col("s"), F.col("t")), n=n, s=s, t=t)
    assert family("PSV", " Prevention", "engineering") == "first" and family("safety", "prevention", "engineering") == "second"
    assert family("x", "prevention", "engineering") == "other_engineering" and family("x", "mitigation", "administrative") == "other_admin"
    assert family("x", "prevention", "ppe") == "other_ppe"


@given(st.lists(st.sampled_from([*taxonomy.ABBREVIATIONS, "valve", "ab", "psvx", "h2s2"]), max_size=6))
@settings(max_examples=15, deadline=None)
def test_expansion_is_a_fold_over_words(spark, words):
    got = value(spark, taxonomy.normalize_control_name(F.col("t")), t=" ".join(words))
    assert got == " ".join(taxonomy.ABBREVIATIONS.get(w, w) for w in words)


def test_agency_tiers(spark):
    cases = [
        (("X", "", "", ""), "X"), (("", "Accident Investigation", "", ""), "BSEE"), (("", "CSB thing", "", ""), "CSB"), (("", "unknown", "https://www.phmsa.dot.gov/a", ""), "PHMSA"),
        (("", "", "", "a/TSB/csb/x.json"), "TSB"), (("", "", "null", "a/b"), "UNKNOWN"),
    ]
    for (a, d, u, p), want in cases:
        assert value(spark, taxonomy.source_agency(F.col("a"), F.col("d"), F.col("u"), F.col("p")), a=a, d=d, u=u, p=p) == want


def test_rules_are_those_of_counting(spark):
    data = [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("4", "c"), ("5", "c"), ("5", "b")]
    items = spark.createDataFrame(data, "incident_id string, item string")
    got = {(r.antecedent, r.consequent): (r.support, round(r.confidence, 6), round(r.lift, 6)) for r in mining.association_rules(items).collect()}
    assert got == {("a", "b"): (0.4, 0.666667, 1.111111), ("b", "a"): (0.4, 0.666667, 1.111111)}


def test_pairs(spark):
    base = [(i, k, int(k > 0)) for i in range(3) for k in range(4)]
    df = spark.createDataFrame(base, "incident_id int, seq int, y_fail int")
    pairs = cascade.barrier_pairs(df, ["seq"])
    assert pairs.count() == 27 and pairs.where("seq_cond = seq_target").count() == 0 and pairs.where("y_fail_cond != 1").count() == 0


def test_waterfall_and_prevalence(spark):
    c = spark.createDataFrame([("i", "c", "pif_training", 1, -4.0), ("i", "c", "side", 0, 3.0), ("i", "c", "lod", 0, -1.0), ("i", "c", "x", 0, 0.5)], "incident_id string, control_id string, feature string, is_context int, value double")
    got = [(r.feature, r.begin) for r in cascade.waterfall(c, 3).orderBy("pos").collect()]
    assert got == [("side", 0.0), ("lod", 3.0), ("pif_training", 2.0)]
    assert rows(cascade.factor_prevalence(c, ["pif_training", "pif_workload"])) == [("pif_training", 1.0), ("pif_workload", 0.0)]


def test_threat_tiers(spark):
    b = spark.createDataFrame([("A", 1, ["T1", "T9"]), ("A", 2, ["T9"]), ("B", 1, []), ("C", 1, ["T1"]), ("D", 1, None)], "incident_id string, control_seq int, linked_threat_ids array<string>")
    fields = "incident_id string, threats array<struct<threat_id:string,threat_name:string>>, top_event string, description string, incident_type string, error string"
    i = spark.createDataFrame([("A", [("T1", "one"), ("T2", "two")], "x", None, None, None), ("B", [], " ", None, "fire", None), ("D", [("T1", "one")], None, None, None, "bad")], fields)
    pairs = threats.threat_barrier_pairs(b, i)
    assert rows(pairs) == [
        ("A", 1, "T1", "one", "explicit"), ("A", 2, "T1", "one", "side_inferred"), ("A", 2, "T2", "two", "side_inferred"), ("B", 1, "T-TOP", "fire", "top_event_only"),
        ("C", 1, "T-UNKNOWN", "Unknown (JSON not found)", "json_missing"), ("D", 1, "T-ERROR", "Error loading JSON: bad", "json_error"),
    ]
    assert threats.uncovered(b, pairs).count() == 0 and {r.mapping_method: r.pairs for r in threats.pair_stats(pairs).collect()}["side_inferred"] == 2


def test_search_and_hybrid(spark):
    unit = lambda k: [math.cos(k / 9), math.sin(k / 9)] + [0.0] * 6
    items = spark.createDataFrame([(k, unit(k), "f" + str(k % 2)) for k in range(15)], "item_id long, item_vec array<double>, family string")
    q = spark.createDataFrame([(0, unit(3), None)], "query_id long, query_vec array<double>, family string")
    assert [r.item_id for r in retrieval.top_k(q, items, 3).orderBy("rank").collect()] == [3, 2, 4]
    masked = retrieval.top_k(q.withColumn("family", F.lit("f0")), items, 99)
    assert {r.item_id % 2 for r in masked.collect()} == {0} and masked.count() == 8
    assert retrieval.top_k(q.withColumn("family", F.lit("none")), items, 5).count() == 0
    assert value(spark, vector.rrf(F.col("a"), F.col("b")), a=1, b=5) == pytest.approx(1 / 61 + 1 / 65)
    assert retrieval.check_unit(items, "item_vec").head().not_unit == 0
    hits, inc = retrieval.top_k(q.drop("family"), items, 5), spark.createDataFrame([(0, 1, 0.9, 1), (0, 0, 0.8, 2)], "query_id long, item_id long, score double, rank int")
    found = retrieval.hybrid(hits, inc, items.select("item_id", (F.col("item_id") % 3).alias("incident_id")))
    assert rows(found, "item_id", "incident_rank") == [(1, 1), (3, 2), (4, 1)]
    low = found.withColumn("barrier_sim", F.lit(0.1))
    assert retrieval.confidence_gate(low).head().message == retrieval.NO_MATCH


def test_budget(spark):
    df = spark.createDataFrame([("q", k, n) for k, n in enumerate([900, 50, 100, 10])], "q string, pos int, size long")
    assert rows(retrieval.within_budget(df, ["q"], ["pos"], "size", 1000), "pos") == [(0,), (1,)]
    assert rows(retrieval.within_budget(df, ["q"], ["pos"], "size", 10), "pos") == [(0,)]


def test_text_gate(spark):
    cases = [("", "EMPTY_TEXT"), (" \n\t ", "EMPTY_TEXT"), ("short", "TOO_SHORT"), ("word " * 100 + "(cid:12)" * 5, "CID_ENCODING_GIBBERISH"), ("12345 67890 " * 50, "LOW_ALPHA_GIBBERISH"), ("plain words here " * 40, "OK")]
    for t, want in cases:
        m = text.text_metrics(F.lit(t))
        assert value(spark, text.extraction_status(m["text_len"], m["alpha_ratio"], m["cid_count"], m["cid_ratio"])) == want
    few = text.text_metrics(F.lit("abcd " * 197 + "(cid:123456789)"))  # 15 of 1,000 characters in one code
    assert value(spark, few["cid_ratio"]) == 0.015 and value(spark, few["cid_count"]) == 1 and value(spark, few["alpha_ratio"]) == 0.791
    assert value(spark, text.extraction_status(few["text_len"], few["alpha_ratio"], few["cid_count"], few["cid_ratio"])) == "CID_ENCODING_GIBBERISH"


def test_text_functions(spark):
    v = lambda c, **d: value(spark, c, **d)
    assert v(text.normalize_text(F.col("t")), t="a b‘c’ “d”\x00\n\n\n\n\n  e     f \t\n") == "a b'c' \"d\"\n\n\ne  f"
    assert v(text.normalize_text(F.col("t")), t="a «b» c–d—e\u2003\u2003\u2003f") == 'a "b" c–d—e  f' and value(spark, text.normalize_text(F.lit(None).cast("string"))) == ""
    assert v(text.sanitize_prompt(F.col("t")), t="System: do {{x}} <prompt a>y</prompt>\n## Ignore all") == "do  y all"
    assert v(text.unquote(F.col("t")), t="a%20b+c") == "a b+c" and v(text.unquote(F.col("t")), t="100%zz") == "100%zz"
    assert v(text.url_doc_id(F.col("t")), t="https://x/y/p23h0001/z.html") == "P23H0001" and v(text.url_doc_id(F.col("t")), t="https://x/a/file.name.pdf?q#f") == "FILE.NAME"
    assert v(text.href_score(F.col("t")), t="/Final-Investigation-Report.pdf") == 6 and v(text.href_score(F.col("t")), t="/assets/recommendation/scs1.pdf") == -18
    assert v(text.parse_date(F.col("t")), t="March 5, 2020") == "2020-03-05" and v(text.parse_date(F.col("t")), t="soon") is None
    assert [v(text.parse_date(F.col("t")), t=t) for t in (" mar 5, 2020", "3/5/2020", "2020-03-05", "5 March 2020")] == ["2020-03-05"] * 3 + [None]
    assert v(text.slug(F.col("t")), t=" Fire & Gas -- Under_score! ") == "fire-gas-under_score" and v(text.slug(F.col("t"), 6), t="a b c d e") == "a-b-c-"
    assert v(text.title_of_slug(F.col("t")), t="-gas-3rd-o_k-") == "Gas 3Rd O_K"
    assert v(text.compose_barrier_text(F.col("a"), F.col("b"), F.lit(None).cast("string")), a="n", b="r") == "Barrier: n\nRole: r\nLOD Basis: N/A"
    whole = text.compose_incident_text(F.col("a"), F.col("a"), F.col("a"), F.array().cast("array<string>"), F.col("a"), F.array(F.lit("x"), F.lit("y")), F.lit(None).cast("array<string>"))
    assert v(whole, a="q") == "Top Event: q\nIncident Type: q\nOperating Phase: q\nMaterials: N/A\nSummary: q\nRecommendations:\nx\ny\nPerformance-Influencing Factor Notes:\nN/A"
    assert v(text.term_count(F.col("t"), "gas"), t="Gas gas. biogas gas_x GAS") == 3
    assert v(text.narrative_ok(F.col("t")), t="One. Two. Three. Four. Five.") is False and v(text.narrative_ok(F.col("t")), t="") is False
    assert v(text.fill_template("a {{x}} b", x=F.lit("1"))) == "a 1 b"
    paths = {"data/pdfs/a.pdf": "data/text/a.txt", "pdfs/pdfs/a.pdf": "text/pdfs/a.txt", "c\\pdfs\\a.PDF": "c/text/a.PDF", "mypdfs/a.pdf": "mypdfs/a.txt"}
    assert {t: v(text.text_path_of(F.col("t")), t=t) for t in paths} == paths


def test_keyword_scores(spark):
    df = spark.createDataFrame([(1, "Gas leak: LOSS of containment, fire! biogas"), (2, None), (3, "explosion gas oil")], "k int, t string")
    got = rows(text.keyword_scores(df, "t"), "k", "primary_hits", "secondary_hits", "context_hits", "loc_score", "loc_flag", "matched_terms")
    assert got == [(1, 2, 1, 2, 7, True, "leak|loss of containment|fire|gas"), (2, 0, 0, 0, 0, False, ""), (3, 0, 1, 3, 4, True, "explosion|gas|oil")]


def test_narrative_of_pages():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><header>h</header><p>one <b>two</b></p><script>x='</p>'</script><footer>f</footer></body></html>"
    assert html.narrative_of(page) == "one\ntwo"
    assert html.narrative_of(page.replace("<p>", "<main><nav>n</nav><p>").replace("</p><script>", "</p></main><script>")) == "one\ntwo"
    assert html.narrative_of(None) == ""
    assert html.narrative_of("<p>no <i>body</i></p><nav>n</nav><script>x</script>") == "no\nbody\nn", "a page without a body gives all its text"


def test_cards_of_listing_pages(spark):
    called = '<a href="/about/">a</a> <a href="/tank-fire/">x</a> <a href="/x/y/">deep</a> Full  Investigation Details <a href="/tank-fire/">again</a> <a href="/investigations-all/">i</a> <a href="/gas-leak/">g</a> full investigation details'
    plain = '<a class="c" href="/pump-fire/"><img><h3>Pump <b>Fire</b></h3></a><a href="/news/"><h3>News</h3></a>'
    df = spark.createDataFrame([(1, called), (2, plain), (3, None)], "page_id int, html string")
    assert rows(html.report_cards(df)) == [(1, "/gas-leak/", "Gas Leak"), (1, "/tank-fire/", "Tank Fire"), (2, "/pump-fire/", "Pump Fire")]
    assert rows(html.document_links(df.where("page_id = 2")), "href", "anchor") == [("/news/", "News"), ("/pump-fire/", "Pump Fire")]


def test_coercion_of_drifting_documents(spark):
    docs = [
        {"incident_id": "1", "event": {"incident_type": ["fire", "spill"]}, "bowtie": {"controls": [{"control_id": "a", "side": "LEFT ", "line_of_defense": 1, "performance": {"barrier_status": "Broken"}, "human": {"human_contribution_value": ["x", "y"]}}, "junk"]}},
        {"incident_id": "2", "event": {"incident_type": 5}, "controls": [{"control_id": "b", "side": "recovery", "line_of_defense": "recovery", "performance": {"barrier_status": "n/a"}}]},
    ]
    df = spark.createDataFrame([(d["incident_id"], json.dumps(d)) for d in docs] + [("3", "{broken"), ("4", "﻿{}")], "incident_id string, payload string")
    parsed = coercion.parse(df)
    assert parsed.where("v is null").count() == 1
    got = coercion.coerced_controls(parsed)
    assert rows(got.na.fill("-"), "control_id", "side", "line_of_defense", "barrier_status", "human_contribution_value") == [("a", "prevention", "1st", "failed", "x; y"), ("b", "mitigation", "recovery", "unknown", "-")]
    counts = {r.coercion: r.n for r in coercion.coercion_counts(parsed).collect()}
    assert counts == {"incident_type_list_to_str": 1, "incident_type_to_str": 1, "side_mapped": 2, "lod_int_to_enum": 1, "barrier_status_mapped": 2, "human_value_list_to_str": 1}
    assert {r.incident_id: r.t for r in parsed.where("v is not null").select("incident_id", coercion.incident_type(F.col("v")).alias("t")).collect()} == {"1": "fire; spill", "2": "5", "4": "unknown"}
    assert ("3", "document: not JSON") in rows(validation.validation_errors(parsed)) and ("4", "incident_id: Field required") in rows(validation.validation_errors(parsed))


def test_lines_and_names_of_lines(spark):
    line = lambda raw, kind: value(spark, coercion.line_of_defense(F.col("r"), F.col("k")), r=raw, k=kind)
    assert [line("3", "BIGINT"), line("9", "BIGINT"), line(" 02 ", "STRING"), line("2ND", "STRING"), line("1st", "STRING"), line("1.0", "DECIMAL(2,1)")] == ["3rd", "unknown", "2nd", "unknown", "1st", "unknown"]


def test_validation_against_the_schema(spark):
    good = {"incident_id": "1", "event": {"top_event": 4, "costs": {}}, "bowtie": {"threats": [{"threat_id": "t", "name": "n", "description": None}], "controls": [{"control_id": "c", "performance": {"barrier_failed": "yes"}, "human": {"human_contribution_value": None}}]}}
    bad = {
        "incident_id": 7, "source": [], "event": {"summary": None, "recommendations": ["a", 1], "key_phrases": "x"}, "pifs": {"work": {"procedures_mentioned": "maybe", "workload_value": 3}},
        "bowtie": {"hazards": [{"name": "n"}, 3], "threats": {}, "controls": [{"side": "left", "performance": {"barrier_failed": None}, "evidence": {"confidence": "High"}}, "x"]},
    }
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("moved", json.dumps({"incident_id": "m", "controls": [{"control_id": 1}]})), ("list", "[]")], "incident_id string, payload string")
    parsed = coercion.parse(df)
    by = {r.incident_id: r for r in validation.validity(parsed).collect()}
    assert by["good"].valid and by["good"].errors == "" and by["list"].errors == "document: Input should be a valid dictionary" and by["moved"].errors == "bowtie -> controls -> 0 -> control_id: Input should be a valid string"
    assert by["bad"].errors.split("; ") == [
        "incident_id: Input should be a valid string", "source: Input should be a valid dictionary", "event -> summary: Input should be a valid string", "event -> recommendations -> 1: Input should be a valid string",
        "event -> key_phrases: Input should be a valid list", "pifs -> work -> procedures_mentioned: Input should be a valid boolean, unable to interpret input", "pifs -> work -> workload_value: Input should be a valid string",
        "bowtie -> hazards -> 0 -> hazard_id: Field required", "bowtie -> hazards -> 1: Input should be a valid dictionary", "bowtie -> threats: Input should be a valid list",
        "bowtie -> controls -> 0 -> control_id: Field required", "bowtie -> controls -> 0 -> side: Input should be 'prevention' or 'mitigation'",
        "bowtie -> controls -> 0 -> performance -> barrier_failed: Input should be a valid boolean", "bowtie -> controls -> 0 -> evidence -> confidence: Input should be 'high', 'medium' or 'low'", "bowtie -> controls -> 1: Input should be a valid dictionary",
    ]


def test_percentiles_are_those_of_sorting(spark):
    import random

    import numpy as np

    random.seed(5)
    for data in ([3.0], [1.0, 2.0], [random.choice([0.0, 1.5, 7.0]) for _ in range(50)], [random.expovariate(1) for _ in range(400)]):
        df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x double")
        got = metrics.percentiles(df, "x", {"a": 0.0, "b": 0.6, "c": 0.95, "d": 1.0}, blocks=7).head()
        assert tuple(got) == pytest.approx(tuple(np.percentile(data, [0, 60, 95, 100])))
    assert tuple(metrics.percentiles(df.limit(0), "x", {"a": 0.5}).head()) == (None,)


def test_percentiles_read_the_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(100).select(F.col("id").cast("double").alias("x")).mapInArrow(seen, "x double")
    assert tuple(metrics.percentiles(rows, "x", {"a": 0.5, "b": 0.9}).head()) == pytest.approx((49.5, 89.1))
    assert read.value == 100


def test_fixed_digits_are_those_of_python(spark):
    import random

    random.seed(9)
    values = [0.03125, 0.09375, 0.02875, 0.00005, 0.0, 1.0, 15.99995, 0.99995, *(round(1 / (60 + a) + 1 / (60 + b), 9) for a in range(1, 20) for b in range(1, 20)), *(k / 20000 for k in range(1, 800, 2)), *(random.random() * 16 for _ in range(300)), -2.5, 100.25]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r.t for r in df.select(text.fixed(F.col("x"), 4).alias("t")).collect()] == [f"{x:.4f}" for x in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(text.fixed(F.col("x"), 4).alias("t")).collect()
    assert len(odd) == 3


def test_context_layout(spark):
    entry = spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in {"rrf_score": 0.03252, "barrier_rank": 1, "incident_rank": 2, "barrier_name": "valve", "barrier_family": "relief", "side": "prevention", "barrier_status": "failed", "barrier_role": "shut", "lod_basis": "N/A", "barrier_failed_human": True, "human_contribution_value": "", "incident_id": "I-1", "incident_summary": "leak"}.items()],
        F.array(F.lit("it failed")).alias("supporting_text"), F.array(F.lit("inspect")).alias("recommendations"), F.create_map(F.lit("work"), F.array(F.lit("time_pressure"))).alias("pif_tags"),
    )
    want = (
        "### Result 1 (RRF: 0.0325, Barrier Rank: 1, Incident Rank: 2)\n**Barrier:** valve\n**Family:** relief | Side: prevention | Status: failed\n**Role:** shut\n**LOD Basis:** N/A\n**Human Failed:** Yes | Human Contribution: N/A\n"
        '**Evidence:**\n- "it failed"\n\n**Parent Incident:** I-1\n**Incident Summary:** leak\n**Recommendations:**\n- inspect\n**Performance Influencing Factors (negative):**\n- Work: time pressure\n'
    )
    assert entry.select(retrieval.context_entry(F.lit(1)).alias("e")).head().e == want
    queries = spark.createDataFrame([("a",), ("b",)], "q string")
    hits = spark.createDataFrame([("a", 1, "x" * 60), ("a", 2, "y" * 20), ("a", 3, "z" * 200), ("a", 4, "w")], "q string, place int, entry string")
    got = {r.q: r.context for r in retrieval.context_text(hits, queries, ["q"], 120).collect()}
    assert got == {"a": "## Similar Barrier Failures\n\n" + "x" * 60 + "\n---\n" + "y" * 20, "b": "## Similar Barrier Failures\n\nNo similar barrier failures found."}


def test_explained_hits_and_evaluation(spark):
    hits = spark.createDataFrame([(1, "I", "c1", 0.03, 1, 1, 1, 0.1), (1, "J", "c2", 0.02, 2, 2, 2, 0.9)], "query_id int, incident_id string, control_id string, rrf_score double, barrier_rank int, incident_rank int, place int, rerank_score double")
    fields = "incident_id string, control_id string, barrier_name string, barrier_family string, side string, barrier_status string, barrier_role string, lod_basis string, barrier_failed_human boolean, human_contribution_value string, supporting_text array<string>"
    known = spark.createDataFrame([(i, c, f"name {c}", "f", "prevention", "failed", "r", "b", False, "v", ["q"]) for i, c in (("I", "c1"), ("J", "c2"))], fields)
    facts = spark.createDataFrame([("I", "s", ["inspect"], None)], "incident_id string, incident_summary string, recommendations array<string>, pif_tags map<string,array<string>>")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.context for r in retrieval.explained(hits, queries, known, facts).collect()}
    assert got[2] == retrieval.NO_CONTEXT and got[1].index("name c1") < got[1].index("name c2") and "- inspect" in got[1]
    again = {r.query_id: r.context for r in retrieval.explained(hits, queries, known, facts, k=1, reranked=True).collect()}
    assert "name c2" in again[1] and "name c1" not in again[1]
    ranked = spark.createDataFrame([(1, "f", 2), (2, "g", 1)], "query_id int, family string, rank int")
    table = retrieval.evaluated({"x": ranked}, spark.createDataFrame([(1, "f"), (2, "f")], "query_id int, family string")).head()
    assert (table.search, table.queries, table.top1, table.top5, table.mrr) == ("x", 2, 0.0, 0.5, 0.25)


def test_metadata_falls_back_to_the_first_row_of_a_control(spark):
    hits = spark.createDataFrame([("A", "c1"), ("X", "c1"), ("X", "c9"), ("B", "c2")], "incident_id string, control_id string")
    known = spark.createDataFrame([("B", "c1", "late", 2), ("Z", "c1", "first", 1), ("A", "c1", None, 3), ("B", "c2", "own", 4)], "incident_id string, control_id string, note string, pos int")
    assert sorted(map(str, (tuple(r) for r in retrieval.with_metadata(hits, known, ["note"], "pos").collect()))) == sorted(map(str, [("A", "c1", None), ("X", "c1", "first"), ("X", "c9", None), ("B", "c2", "own")]))


def test_grid_search_equals_the_small_one(spark, monkeypatch):
    import random

    random.seed(3)
    items = spark.createDataFrame([(k, [random.gauss(0, 1) for _ in range(6)], k % 3) for k in range(300)], "item_id long, item_vec array<double>, family long")
    queries = spark.createDataFrame([(k, [random.gauss(0, 1) for _ in range(6)], k % 4 if k % 4 < 3 else None) for k in range(40)], "query_id long, query_vec array<double>, family long")
    want = rows(retrieval.top_k(queries, items, 7))
    for r in queries.collect()[:5]:
        scores = sorted(((-round(sum(a * b for a, b in zip(r.query_vec, i.item_vec, strict=True)), 6), i.item_id) for i in items.collect() if r.family in (None, i.family)))[:7]
        assert [(w[1], w[2]) for w in sorted(want, key=lambda w: w[3]) if w[0] == r.query_id] == [(i, pytest.approx(-s)) for s, i in scores]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 70)
    assert rows(retrieval.top_k(queries, items, 7)) == want


def test_json_in_answers(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Sure: {"a": "}{"} and more', "{bad} then {\"a\": 4}", "none", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.json for r in coercion.json_in_answer(df, "t").collect()}
    assert [json.loads(got[k])["a"] for k in range(4)] == [1, 2, "}{", 4] and got[4] is None and got[5] is None


def test_metrics(spark):
    data = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.4)]
    df = spark.createDataFrame(data, "y int, score double")
    auc = sum((p > n) + 0.5 * (p == n) for y, p in data if y for z, n in data if not z) / 6
    assert metrics.roc_auc(df, blocks=3).head().auc == pytest.approx(auc)
    m = metrics.binary_metrics(df).head()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision) == (1, 0, 2, 2, 1.0)
    none = metrics.binary_metrics(df.where("y = 0")).head()
    assert none.f1 == 0.0 and none.mcc == 0.0
    groups = spark.createDataFrame([(g, k) for g in range(40) for k in range(1 + g % 7)], "g long, k int")
    folds = metrics.fold_assignment(groups, "g", 5)
    assert folds.count() == 40 and folds.select("fold").distinct().count() == 5


def dealt(sizes, folds):
    """Loads of longest-first dealing, one group at a time."""
    loads = [0] * folds
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


@pytest.mark.parametrize("folds", [2, 3, 5])
def test_folds_are_dealt_longest_first(spark, folds):
    """Keys of any type, groups whole, loads as if dealt one by one, however the rows lie."""
    import random

    rng = random.Random(folds)
    sizes = [1] * 57 + [2] * 31 + [rng.randint(1, 40) for _ in range(20)] + [300]
    data = [(f"inc-{k}" if k else None, {"a": k}) for k, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(data, "incident_id string, m map<string,int>")
    got = metrics.fold_assignment(df, "incident_id", folds).collect()
    loads = [sum(r.n for r in got if r.fold == f) for f in range(folds)]
    assert sorted(r.grp or "" for r in got) == sorted(f"inc-{k}" if k else "" for k in range(len(sizes))) and loads == dealt(sizes, folds)
    again = metrics.fold_assignment(df.repartition(7).select(F.struct("incident_id").alias("key")), "key", folds).collect()
    assert sorted((r.grp.incident_id or "", r.fold) for r in again) == sorted((r.grp or "", r.fold) for r in got)
    assert metrics.fold_assignment(df.limit(0), "incident_id", folds).collect() == []
    for trial in range(50):
        histogram = {rng.randint(1, 30): rng.randint(1, 40) for _ in range(rng.randint(1, 8))}
        quotas = metrics.fold_quotas(histogram, folds)
        assert [sum(n * q[f] for n, q in quotas.items()) for f in range(folds)] == dealt([n for n, c in histogram.items() for _ in range(c)], folds), trial
        assert all(sum(quotas[n]) == c for n, c in histogram.items())


def test_blocks_of_heavy_tails(spark):
    """One value far off, and scores that crowd together: no block holds more than a twentieth of the distinct values, and results are exact."""
    import random

    rng = random.Random(3)
    values = [rng.random() / 1000 for _ in range(5000)] + [1e12, -1e15]
    df = spark.createDataFrame([(x, int(rng.random() < 0.4 + 300 * min(max(x, 0), 1e-3))) for x in values], "score double, y int")
    counts = df.groupBy("score").agg(F.count("*").alias("n"))
    largest = metrics._blocked(counts, [], "score", 256).groupBy("block").count().agg(F.max("count")).head()[0]
    assert largest <= 5002 / 20
    ordered, got = sorted(values), metrics.percentiles(df, "score", {"a": 0.5, "b": 0.999})
    place = lambda s: (lambda p: ordered[int(p)] + (p - int(p)) * (ordered[min(int(p) + 1, 5001)] - ordered[int(p)]))(5001 * s)
    assert tuple(got.head()) == pytest.approx((place(0.5), place(0.999)))
    data = sorted((r.score, r.y) for r in df.collect())
    positives = [k for k, (_, y) in enumerate(data) if y]
    auc = (sum(positives) + len(positives) - len(positives) * (len(positives) + 1) / 2) / (len(positives) * (len(data) - len(positives)))
    assert metrics.roc_auc(df).head().auc == pytest.approx(auc, abs=1e-8)
    keyed = df.withColumn("k", F.col("y") * 0 + (F.col("score") > 0.0005).cast("int"))
    assert metrics.roc_auc(keyed, ["k"]).count() == 2


def test_cross_validation_and_contributions(spark):
    import random

    random.seed(1)
    data = [(k, k // 6, x := random.random(), random.random(), int(x + random.gauss(0, 0.2) > 0.5)) for k in range(240)]
    df = spark.createDataFrame(data, "id long, grp long, a double, b double, y int")
    per_fold = ml.cross_validate(ml.logistic, df, ["a", "b"], "y", "grp", folds=3)
    assert per_fold.count() == 3 and metrics.auc_gate(per_fold).head().passed
    parts = ml.linear_contributions(df, ["a", "b"], {"a": 2.0, "b": -1.0}, ["id"])
    assert abs(parts.agg(F.sum("value")).head()[0]) < 1e-6
    assert metrics.branch(per_fold).head().branch == "A"
    fold = lambda *aucs: spark.createDataFrame([(x,) for x in aucs], "auc double")
    assert [metrics.branch(fold(*x)).head().branch for x in ((0.9, 0.59), (0.8, 0.6), (0.6, 0.54), (0.6, 0.6), (0.5, 0.5))] == ["B", "A", "C", "B", "C"]
    assert rows(ml.ablation(per_fold, per_fold), "impact") == [("neutral",), ("neutral",)]


def test_context_and_providers(spark):
    recs = spark.createDataFrame([("q", 2, ["b", "a"]), ("q", 1, ["a", ""]), ("q", 3, ["c", "d", "e", "f"])], "q string, pos int, recommendations array<string>")
    assert context.ordered_recommendations(recs, ["q"]).head().recommendations == ["a", "b", "c", "d", "e"]
    assert value(spark, context.condition(F.col("s")), s="bypassed") == "ineffective" and value(spark, context.condition(F.col("s")), s="zzz") == "status_unknown"
    e = providers.provider("hashing", dimension=16)
    vecs = [r.embedding for r in providers.embedded(spark.createDataFrame([("gas leak",), ("gas leak",), ("",)], "t string"), "t", e).collect()]
    assert vecs[0] == vecs[1] and abs(sum(x * x for x in vecs[0]) - 1) < 1e-9 and not any(vecs[2])
    checked = providers.embedded_checked(spark.createDataFrame([("a",)], "t string"), "t", e)
    assert len(checked.head().embedding) == 16

    class Short:
        dimension = 3

        def embed(self, texts):
            return [[0.0] * 2 for _ in texts]

    with pytest.raises(Exception, match="stated size"):
        providers.embedded_checked(spark.createDataFrame([("a",)], "t string"), "t", Short()).collect()
    assert value(spark, providers.lexical_rerank(F.col("a"), F.col("b")), a="Gas leak alarm", b="the alarm for gas") == pytest.approx(2 / 3)
    ladder = providers.Ladder([("small", providers.StubModel("no")), ("big", providers.StubModel("{}"))], lambda a: a == "{}", retries=2)
    assert ladder.run("p") == ("big", "{}", ["small", "small", "big"])


def test_manifest_merge_priorities(spark):
    schema = "source string, incident_id string, pdf_url string, downloaded boolean, retrieved_at timestamp, sha256 string, file_size_bytes long, title string, date_occurred string"
    import datetime as dt

    t1, t2 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    existing = spark.createDataFrame([("s", "1", "u1", True, t1, None, None, "", "2019"), ("s", "2", "u2", False, t1, "x", 5, "keep", None), ("s", "3", "", False, None, None, None, "old", None)], schema)
    new = spark.createDataFrame([("s", "9", "u1", False, t2, "z", 9, "lent", "2000"), ("s", "2", "u2", False, t1, "y", 7, None, "1999"), ("s", "3", None, False, None, None, None, "new", None), ("t", "1", "u1", True, t1, None, None, "other", None)], schema)
    got = rows(manifests.merge(existing, new), "source", "incident_id", "title", "date_occurred", "file_size_bytes")
    assert sorted(map(str, got)) == sorted(map(str, [("s", "1", "lent", "2019", None), ("s", "2", "keep", "1999", 7), ("s", "3", "old", None, None), ("t", "1", "other", None, None)]))
    assert rows(manifests.pending(new, existing, "incident_id"), "incident_id") == [("9",)] and manifests.pending(new, existing, "incident_id", force=True).count() == 4


def test_page_links(spark):
    page = '<a href="/x/Report-2019.pdf">Fire in 2019</a> <a href="/x/Report-2019.pdf">again</a><a href="/d/all.ZIP?x">z</a> <a class="c" href="/r/p20h0001/p20h0001.html">r</a></td><td>2020-05-06</td>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    assert rows(html.pdf_anchors(df)) == [("/x/Report-2019.pdf", "fire-in-2019", "Fire in 2019", "2019-01-01")]
    assert rows(html.data_links(df)) == [(1, "/d/all.ZIP?x")]
    assert rows(html.listing_links(df)) == [("P20H0001", "/r/p20h0001/p20h0001.html", "2020-05-06")]
    best = html.best_report(html.links(df), "page_id", text.href_score(F.col("href")))
    assert best.head().href == "/x/Report-2019.pdf"


def test_checks_that_stop(spark, controls):
    good, bad = profiling.reject(controls, "side", ["prevention"])
    assert good.count() == 2 and {r.reason for r in bad.collect()} == {"side: mitigation"}
    with pytest.raises(Exception, match="side: mitigation"):
        profiling.strict(controls, "side", ["prevention"]).collect()
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert profiling.left_join_checked(left, left.withColumn("x", F.lit(1)), "k").count() == 2
    for other in (left.where("k = 1"), left.union(left)):
        with pytest.raises(Exception, match="match"):
            profiling.left_join_checked(left, other.withColumn("x", F.lit(1)), "k").collect()
    assert profiling.in_scope(controls, controls.where("side = 'prevention'")).count() == 2


def test_small_helpers(spark, controls):
    assert [value(spark, text.parse_bool(F.col("t")), t=t) for t in ("Yes", " 1", "no", "")] == [True, True, False, False]
    assert value(spark, text.safe_filename(F.col("t")), t=" A b/c?.json ") == "A_b_c_.json"
    assert [r.name for r in cascade.sort_rows(controls, "name", True).collect()][0] in ("x",) and cascade.filter_rows(controls, side="mitigation", name=None).count() == 3
    f = spark.createDataFrame([(True, None, True)], "pif_competence boolean, pif_fatigue boolean, pif_communication boolean").withColumn("pif_situational_awareness", F.lit(False))
    r = f.select(context.mentioned("people").alias("m"), cascade.factor_count(f.columns).alias("n")).head()
    assert r.m == {"competence": True, "communication": True} and r.n == 2


def test_tree_contributions_are_shapley_values(spark):
    """Against the definition: every subset of features, unknown ones averaged by training rows; and against the model's own probability."""
    import itertools
    import random

    import numpy as np
    from hazardframe.operators import trees
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    random.seed(2)
    data = [(k, a := random.random(), b := random.random(), c := random.random(), int(a + b * c + random.gauss(0, 0.1) > 0.8)) for k in range(300)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y int")
    stages = [VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), GBTClassifier(labelCol="y", maxIter=3, maxDepth=3, seed=1)]
    theirs = Pipeline(stages=stages).fit(df)
    parts = trees.explained(theirs, df, ["a", "b", "c"], ["id"]).groupBy("id").agg(F.first("score").alias("score"), F.sum("value").alias("total")).collect()
    assert all(math.log(r.score / (1 - r.score)) == pytest.approx(r.total + trees.forest_of(theirs).expectation(), abs=1e-6) for r in parts)
    model = ml.boosted(["a", "b", "c"], "y", rounds=4).fit(ml.weighted(df, "y"))
    forest = model.forest

    def known(tree, x, s, node=0):
        f = int(tree.feature[node])
        if f < 0:
            return tree.value[node]
        left, right = int(tree.left[node]), int(tree.right[node])
        if f in s:
            return known(tree, x, s, left if x[f] <= tree.threshold[node] else right)
        return (tree.cover[left] * known(tree, x, s, left) + tree.cover[right] * known(tree, x, s, right)) / tree.cover[node]

    for x in np.random.default_rng(0).random((5, 3)):
        want = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for k, f in enumerate(order):
                gain = sum(w * (known(t, x, {*order[: k + 1]}) - known(t, x, {*order[:k]})) for t, w in zip(forest.trees, forest.weights, strict=True))
                want[f] += gain / 6
        assert np.allclose(forest.contributions(x), want, atol=1e-9)
    parts = trees.explained(model, ml.weighted(df, "y"), ["a", "b", "c"], ["id"])
    sums = parts.groupBy("id").agg(F.first("score").alias("score"), F.sum("value").alias("total")).collect()
    assert len(sums) == 300 and all(math.log(r.score / (1 - r.score)) == pytest.approx(r.total + forest.expectation(), abs=1e-6) for r in sums)


def test_cascade_models_are_trained_saved_and_loaded(spark, tmp_path):
    import random

    from hazardframe.sources import sinks

    random.seed(4)
    pairs = spark.createDataFrame([(k // 5, "ab"[k % 2], float(k % 9), int(k % 9 + random.random() > 5)) for k in range(150)], "incident_id long, kind string, n double, y int")
    model, meta = ml.train_cascade(pairs, ["kind"], ["n"], "y", folds=3, rounds=3)
    assert meta["all_features"] == ["kind", "n"] and meta["training_rows"] == 150 and len(meta["cv_scores"]["per_fold"]) == 3 and meta["cv_scores"]["mean"] > 0.8
    sinks.save_model(model, f"{tmp_path}/m", meta)
    p = ml.Predictor.load(spark, f"{tmp_path}/m")
    unseen = spark.createDataFrame([(1, "zz", 8.0), (2, "a", 0.0)], "id long, kind string, n double")
    got = {r.id: r.p for r in p.predict(unseen, "id").collect()}
    assert got[1] > 0.5 > got[2] and p.explain(unseen, "id").count() == 4
    with pytest.raises(ValueError, match="needs"):
        p.predict(unseen.drop("n"), "id")
    named = pairs.withColumn("incident_id", F.concat(F.lit("inc-"), F.col("incident_id").cast("string")))
    assert len(ml.train_cascade(named, ["kind"], ["n"], "y", folds=2, rounds=2)[1]["cv_scores"]["per_fold"]) == 2
    both = ml.retrain(pairs.withColumn("source_agency", F.lit("x")), ["n"], ["y"], "incident_id", folds=2, rounds=2)
    assert both["y"]["boosted"]["folds"].count() == 2 and both["y"]["background"].count() == 150


def test_boosted_trees_are_the_stated_ones():
    learner = ml.boosted(["a"], "y")
    assert (learner.rounds, learner.depth, learner.step, learner.rows_share, learner.columns_share, learner.least_hessian, learner.leaf_weight, learner.seed) == (400, 4, 0.05, 0.8, 0.8, 5.0, 1.0, 42)


def brute_boosting(learner, chunks, x, y, w, cuts):
    """Trees by trying every cut of every chosen column at every node, over all rows at once; margins of the rows."""
    import numpy as np
    from hazardframe.operators import boosting

    base = np.log((w @ y) / (w @ (1 - y)))
    margin, missing = np.full(len(y), base), np.isnan(x)
    for k in range(learner.rounds):
        columns = np.sort(np.random.default_rng([learner.seed, k]).choice(x.shape[1], max(1, int(learner.columns_share * x.shape[1])), replace=False))
        used = np.concatenate([boosting.drawn(c, n, learner.seed, k, learner.rows_share) for c, n in chunks])
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, p * (1 - p) * w
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)  # noqa: E731, B023

        def grow(rows, depth):
            learnt = rows & used  # noqa: B023
            best, choice = 1e-6, None
            for f in columns if depth else ():  # noqa: B023
                for cut in cuts[f]:
                    for lost_left in (False, True) if missing[learnt, f].any() else (False,):
                        goes = np.where(missing[:, f], lost_left, x[:, f] <= cut)
                        left, right = learnt & goes, learnt & ~goes
                        if min(h[left].sum(), h[right].sum()) >= learner.least_hessian and (gain := score(left) + score(right) - score(learnt)) > best + 1e-7:  # noqa: B023
                            best, choice = gain, goes
            if choice is None:
                margin[rows] += -learner.step * g[learnt].sum() / (h[learnt].sum() + 1)  # noqa: B023
            else:
                grow(rows & choice, depth - 1)
                grow(rows & ~choice, depth - 1)

        grow(np.ones(len(y), bool), learner.depth)
    return margin


def test_boosting_equals_brute_force(spark, tmp_path, monkeypatch):
    """Missing values, categories, several chunks and tasks, margins written on the way; and the same model from its file."""
    import json

    import numpy as np
    from hazardframe.operators import boosting

    rng = np.random.default_rng(7)
    monkeypatch.setattr(boosting, "CHUNK", 90)
    monkeypatch.setattr(boosting, "TASK_CHUNKS", 2)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    n = 400
    a, b, kind = rng.integers(0, 12, n).astype(float), rng.random(n).round(1), rng.choice(["p", "q", "r", None], n)
    y = ((a > 5) ^ (b > 0.6) | (kind == "q") & (rng.random(n) < 0.7)).astype(int)
    a[rng.random(n) < 0.15] = np.nan
    data = [(k, None if np.isnan(a[k]) and k % 2 else float(a[k]), float(b[k]), kind[k], int(y[k])) for k in range(n)]
    df = spark.createDataFrame(data, "id long, a double, b double, kind string, y int").coalesce(1)
    learner = boosting.Learner(["kind", "a", "b"], "y", rounds=5, depth=3, least_hessian=2.0, weight="weight", categorical=("kind",))
    rows = ml.weighted(df, "y")
    model = learner.fit(rows)
    x = np.column_stack([[["p", "q", "r"].index(c) if c else -1 for c in kind], a, b]).astype(float)
    w = np.where(y == 1, (n - y.sum()) / y.sum(), 1.0)
    sizes = [min(90, n - at) for at in range(0, n, 90)]
    margin = brute_boosting(learner, list(enumerate(sizes)), x, y, w, [np.unique(c[~np.isnan(c)]) for c in x.T])
    got = {r.id: math.log(r.score / (1 - r.score)) for r in model.scored(rows, "id").collect()}
    assert np.allclose([got[k] for k in range(n)], margin, atol=1e-6) and any(t.missing_left.any() for t in model.trees)
    assert np.allclose([model.forest.margin(r) for r in x], margin, atol=1e-6)
    spread = learner.fit(rows.repartition(3))
    assert len(spread.trees) == 5 and learner.fit(rows.limit(0)).trees == []
    boosting.write_boosted(spark, model, f"{tmp_path}/m")
    back = boosting.read_boosted(spark, f"{tmp_path}/m")
    assert back.features == model.features and back.categories == model.categories
    again = {r.id: math.log(r.score / (1 - r.score)) for r in back.scored(rows, "id").collect()}
    assert np.allclose([again[k] for k in range(n)], margin, atol=1e-5)
    told = json.loads(spark.read.text(f"{tmp_path}/m", wholetext=True).head()[0])["learner"]
    assert told["learner_model_param"]["num_feature"] == "3" and len(told["gradient_booster"]["model"]["trees"]) == 5


def test_a_model_file_of_another_library(spark, tmp_path):
    """Strict comparisons with 32-bit thresholds, default directions, the base score as a probability."""
    import json

    tree = {
        "left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [0, 0, 1, 0, 0], "split_conditions": [0.1, -0.5, 3.0, 0.25, 1.5],
        "default_left": [0, 0, 1, 0, 0], "sum_hessian": [4.0, 1.0, 3.0, 1.0, 2.0], "split_type": [0] * 5,
    }
    model = {"learner": {"gradient_booster": {"model": {"trees": [tree, tree]}}, "learner_model_param": {"base_score": "[2E-1]", "num_feature": "2", "num_class": "0"}, "objective": {"name": "binary:logistic"}}}
    (tmp_path / "m.json").write_text(json.dumps(model))
    from hazardframe.operators import boosting

    back = boosting.read_boosted(spark, f"{tmp_path}/m.json")
    cases = [(0.05, 9.0, -0.5), (0.1, 2.0, 0.25), (0.1, 3.0, 1.5), (None, None, 0.25), (float("nan"), 3.0, 1.5), (5.0, float("nan"), 0.25), (0.09999999, 0.0, -0.5)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "id int, f0 double, f1 double")
    got = {r.id: math.log(r.score / (1 - r.score)) for r in back.scored(df, "id").collect()}
    assert back.features == ["f0", "f1"] and got == {k: pytest.approx(math.log(0.2 / 0.8) + 2 * v) for k, (_, _, v) in enumerate(cases)}


def test_the_stored_index_reads_few_cells(spark, tmp_path):
    """Clustered vectors: the answers of a scan from fewer than half of the cells; odd sizes too."""
    import numpy as np
    from hazardframe.operators import retrieval, vector_index

    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.15 * rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "item_id long, item_vec array<double>")
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 3000, 300)], "query_id long, query_vec array<double>")
    vector_index.build(items, f"{tmp_path}/i", cells=40)
    found, told = vector_index.search(spark, f"{tmp_path}/i", queries, 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.top_k(queries, items, 10).select(*found.columns).collect()))
    assert told["cells"] <= 40 and 0 < told["read"] <= told["cells"] / 2
    stretched = items.select("item_id", F.transform("item_vec", lambda v: v * (1 + F.col("item_id") % 3)).alias("item_vec"))
    vector_index.build(stretched, f"{tmp_path}/s", cells=12)
    found, _ = vector_index.search(spark, f"{tmp_path}/s", queries, 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.top_k(queries, stretched, 7).select(*found.columns).collect()))
    vector_index.build(items.limit(1), f"{tmp_path}/one")
    assert vector_index.search(spark, f"{tmp_path}/one", queries, 3)[0].count() == 10


def test_documents_are_opened_once_for_all_their_fields(spark):
    """Time grew with the look-ups in a document's text for each of its fields, most of which are absent; now each object has one."""
    df = spark.createDataFrame([(1, "{}")], "incident_id long, payload string")
    plan = validation.validation_errors(coercion.parse(df))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"variant_get\(v#", plan)) < 20, "a look-up from the whole document for each field"
    odd = [
        '{"incident_id":"a","pifs":{"people":[1]},"event":null,"source":{"url":null,"title":null}}',
        '{"incident_id":"b","bowtie":{"controls":{},"threats":null},"controls":[null,{"control_id":"c","performance":[],"linked_threat_ids":["x",null]}]}',
        '{"incident_id":"c","bowtie":7}', "7", "null", '{"incident_id":null}',
    ]
    got = {r.payload: r.errors for r in coercion.parse(spark.createDataFrame([(t, t) for t in odd], "incident_id string, payload string")).select("payload", F.array_join(validation.document_errors(F.col("v")), "; ").alias("errors")).collect()}
    assert [got[t] for t in odd] == [
        "source -> title: Input should be a valid string; event: Input should be a valid dictionary; pifs -> people: Input should be a valid dictionary",
        "bowtie -> threats: Input should be a valid list; bowtie -> controls: Input should be a valid list; bowtie -> controls -> 0: Input should be a valid dictionary; bowtie -> controls -> 1 -> linked_threat_ids -> 1: Input should be a valid string; "
        "bowtie -> controls -> 1 -> performance: Input should be a valid dictionary",
        "bowtie: Input should be a valid dictionary", "document: Input should be a valid dictionary", "document: Input should be a valid dictionary", "incident_id: Input should be a valid string",
    ]


def test_reasons_of_worst_shuffle_barriers_once(spark):
    """Every pair of barriers with every feature was shuffled; only barriers are now. Checked against all pairs, with a repeated id, a tie and lone barriers."""
    made = [(i, s, f"C-{s % 5 if i == 3 else s}", (i * 7 + s * 13) % 50) for i in range(6) for s in range(1, 2 + 2 * i)]
    p = lambda c, t: (c * 31 + t * 17) % 10 / 10
    value = lambda c, t, i: (c * (2 * i + 1) + t * (i + 3)) % 23 - 11
    want = []
    for i in range(6):
        mine = [m for m in made if m[0] == i]
        for name in sorted({m[2] for m in mine}):
            runs = [(p(c[3], t[3]), c[2], c[3], t[3]) for t in mine for c in mine if t[2] == name and c[1] != t[1]]
            kept = [(abs(value(c, t, k)), f) for _, n, c, t in runs if n == max(runs)[1] for k, f in enumerate("abc")]
            want += [(i, name, f, size, n + 1) for n, (size, f) in enumerate(sorted(kept, key=lambda x: (-x[0], x[1]))[:2])]
    df = spark.createDataFrame(made, "incident_id long, control_seq long, control_id string, quantity int")
    chance = lambda c, t: (c["quantity"] * 31 + t["quantity"] * 17) % 10 / F.lit(10.0)
    reasons = lambda c, t: F.array(*[F.struct(F.lit(f).alias("feature"), value(c["quantity"], t["quantity"], k).alias("value")) for k, f in enumerate("abc")])
    got = cascade.reasons_of_worst(df, chance, reasons)
    assert rows(got.withColumn("value", F.abs("value")), "incident_id", "control_id", "feature", "value", "n") == sorted(want)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
