"""Readers, sinks, streams and the command line on files."""

import json
import time
from urllib.parse import quote

import pytest
from hazardframe import api, cli, schemas
from hazardframe.operators import manifests, providers
from hazardframe.sources import connectors, crawl, extraction, files, incidents, npy, quarantine, sinks
from hazardframe.streaming import manifests as streams
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC = {
    "incident_id": "I-1", "source": {"doc_type": "CSB report", "url": ""}, "context": {"region": "Gulf", "materials": "oil"},
    "event": {"top_event": "Leak", "incident_type": ["fire"], "costs": 5}, "pifs": {"people": {"fatigue_mentioned": True}},
    "bowtie": {"controls": [
        {"control_id": "C-1", "name": "PSV", "side": "prevention", "barrier_type": "engineering", "linked_threat_ids": ["T1", "T2"], "performance": {"barrier_status": "failed", "barrier_failed": True}, "evidence": {"supporting_text": ["a", "b"], "confidence": "high"}},
        "junk",
        {"control_id": "C-2", "side": "left", "line_of_defense": 1},
    ]},
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "csb").mkdir(parents=True)
    (tmp_path / "in" / "csb" / "one.json").write_text("﻿" + json.dumps(DOC), encoding="utf-8")
    (tmp_path / "in" / "bad.json").write_text("{oops")
    (tmp_path / "in" / "two.json").write_text(json.dumps({"bowtie": {}, "pifs": None}, indent=1))
    return tmp_path


def test_incident_files(spark, folder):
    parsed = incidents.read_json(spark, str(folder / "in"))
    assert parsed.count() == 3 and parsed.where("v is null").count() == 1
    flat = {r.incident_id: r for r in incidents.flat_incidents(parsed).collect()}
    assert sorted(flat) == ["I-1", "two"] and flat["I-1"].source_agency == "CSB" and flat["I-1"].provider_bucket == "csb"
    assert flat["I-1"].incident__event__incident_type == "fire" and flat["I-1"].incident__context__materials == "oil" and flat["I-1"].incident__pifs__people__fatigue_mentioned
    assert flat["I-1"].incident__pifs__people__fatigue_value == "" and len(flat["I-1"]) == 41
    assert flat["two"].incident__event__top_event == "" and not flat["two"].incident__pifs__people__fatigue_mentioned
    controls = incidents.flat_controls(parsed).orderBy("control_id").collect()
    assert [(c.control_id, c.linked_threat_ids, c.supporting_text_count, c.line_of_defense) for c in controls] == [("C-1", "T1,T2", 2, ""), ("C-2", "", 0, "1")]
    assert incidents.typed(parsed).where("incident_id = 'I-1'").count() == 1


def test_text_sources(spark, tmp_path):
    blocks = "ID: 1\nDate: 2020-01-02\nDescription: first\n goes on\nCauses: a, b,\n\nID: 2\n\nID: 3\nDescription: x\nDate: soon"
    got = files.text_blocks(spark.createDataFrame([(blocks,)], "text string")).orderBy("incident_id").collect()
    assert [(r.incident_id, r.date_occurred, r.description, r.causes) for r in got] == [("1", "2020-01-02", "first  goes on", ["a", "b"]), ("3", None, "x", [])]
    (tmp_path / "u.csv").write_text("doc_id,url\n,https://x/a/b.pdf?x=1\nk,https://y\n,\n")
    assert sorted(map(tuple, files.read_url_list(spark, str(tmp_path / "u.csv")).collect())) == [("b", "https://x/a/b.pdf?x=1"), ("k", "https://y")]
    for d, t in (("a", "one"), ("b", "two")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "s.txt").write_text(t)
    (tmp_path / "b" / "r.txt").write_text("three")
    stems = spark.createDataFrame([("s",), ("r",), ("q",)], "stem string")
    assert {r.stem: r.text for r in files.first_text(spark, stems, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()} == {"s": "one", "r": "three", "q": None}
    bulk = spark.createDataFrame([("7", "Op", "01/02/2020"), ("8", None, "x")], "REPORT_NUMBER string, Operator_Name string, Incident_Date string")
    bulk = spark.createDataFrame([(" A 7 ", "Op", " 01/02/2020", "n" * 300), (None, None, "x", None)], "REPORT_NUMBER string, Operator_Name string, Incident_Date string, Narrative string").coalesce(1)
    assert [(r.doc_id, r.title, r.date, r.source) for r in files.bulk_candidates(bulk).collect()] == [("a-7", "n" * 200, "01/02/2020", "phmsa"), ("phmsa-00001", "PHMSA incident phmsa-00001", "x", "phmsa")]
    assert files.bulk_candidates(bulk, limit=1).count() == 1
    many = spark.range(100).repartition(5)
    assert sorted(r.n for r in files.numbered(many).collect()) == list(range(100))


def test_manifests_round_trip(spark, tmp_path):
    row = dict.fromkeys(schemas.MANIFEST.fieldNames()) | {"source": "s", "incident_id": "1", "downloaded": True, "file_size_bytes": 5, "title": 'a "b", c'}
    df = spark.createDataFrame([row, row | {"incident_id": "2", "downloaded": False, "title": None}], schemas.MANIFEST)
    sinks.write_manifest(df, str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m"), schemas.MANIFEST)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    sinks.write_csv(df.limit(0), str(tmp_path / "e"))
    assert any("incident_id" in p.read_text() for p in (tmp_path / "e").glob("*.csv"))


def test_documents_and_extractors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    docs = files.read_documents(spark, str(tmp_path))
    assert {r.stem: r.size for r in docs.collect()} == {"a": 4, "b": 1}
    raw = spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))
    out = {r.path[-5:]: r for r in files.extract_text(raw, [("first", lambda b: ""), ("utf8", lambda b: b.decode())]).collect()}
    assert out["a.pdf"].extractor_used == "utf8" and out["a.pdf"].text == "good" and out["b.pdf"].fail_reason.startswith("utf8")


def test_streams_merge_once(spark, tmp_path):
    """Only folders that a batch's keys fall in are written; a batch that comes again changes nothing."""
    row = dict.fromkeys(schemas.MANIFEST.fieldNames()) | {"source": "s", "incident_id": "1", "pdf_url": "u", "downloaded": False, "title": "first"}
    write = lambda n, *rows: spark.createDataFrame(list(rows), schemas.MANIFEST).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    table = streams.merged_table(spark, f"{tmp_path}/table", schemas.MANIFEST)
    files_of = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}

    def run():
        streams.merge_stream(spark, f"{tmp_path}/in/*", schemas.MANIFEST, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r.incident_id, r.title, r.downloaded) for r in table.read().collect())

    many = [row | {"incident_id": f"m{k}", "pdf_url": f"u{k}", "title": "m"} for k in range(300)]
    rest = [(f"m{k}", "m", False) for k in range(300)]
    write("a", row, *many)
    assert run() == sorted([("1", "first", False), *rest])
    before = files_of()
    write("b", row | {"downloaded": True, "title": None}, row | {"incident_id": "2", "pdf_url": None})
    want = sorted([("1", "first", True), ("2", "first", False), *rest])
    assert run() == want
    after = files_of()
    assert len(before) >= 50 and len(before.items() - after.items()) <= 2 and len(after.items() - before.items()) <= 2
    assert run() == want and files_of() == after
    touched = table.fold(spark.read.schema(schemas.MANIFEST).parquet(f"{tmp_path}/in/b"), manifests.merge)
    assert 1 <= len(touched) <= 2 and sorted((r.incident_id, r.title, r.downloaded) for r in table.read().collect()) == want
    keyed = streams.upserted_table(spark, f"{tmp_path}/keyed", T.StructType.fromDDL("k string, v int, row_order int"), "k", 8)
    put = lambda rows: keyed.fold(spark.createDataFrame(rows, keyed.schema), lambda a, b: manifests.upsert(a, b, "k"))
    assert put([]) == [] and keyed.read().count() == 0
    put([("a", 1, 0), ("b", 1, 1), ("a", 2, 2), (None, 3, 3)])
    put([("b", 5, 0)])
    assert sorted((r.k or "", r.v) for r in keyed.read().collect()) == [("", 3), ("a", 2), ("b", 5)]


def test_matrices(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(0).random((1000, 7)).astype(np.float32)
    np.save(tmp_path / "m.npy", x)
    spark.dataSource.register(npy.NpySource)
    read = lambda path, **o: spark.read.format("npy").options(**o).load(str(path))
    got = read(tmp_path / "m.npy", partBytes=7000)
    assert got.rdd.getNumPartitions() == 4 and np.array_equal(np.array([r.vector for r in got.orderBy("row").collect()], np.float32), x)
    assert [r.row for r in got.select("row").orderBy("row").collect()] == list(range(1000))
    assert npy.write_npy(got, f"{tmp_path}/parts", "vector", ["row"]) == 1000
    again = read(tmp_path / "parts")
    assert np.array_equal(np.array([r.vector for r in again.orderBy("row").collect()], np.float32), x)
    spark.createDataFrame([(f"b{k:04d}",) for k in range(1000)], "name string").coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    rows = files.numbered(files.read_csv(spark, f"{tmp_path}/c"), "row")
    met = npy.positional(again, rows)
    assert {r.name: r.vector[0] for r in met.collect()} == {f"b{k:04d}": float(x[k, 0]) for k in range(1000)}
    with pytest.raises(Exception, match="no partner for row 999"):
        npy.positional(again, rows.where("row < 999")).collect()
    np.save(tmp_path / "one.npy", np.arange(5))
    assert [r.vector for r in read(tmp_path / "one.npy").orderBy("row").collect()] == [[float(k)] for k in range(5)]
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert read(tmp_path / "none.npy").count() == 0
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="C order"):
        read(tmp_path / "f.npy").count()


def test_quarantine(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for name in ("a/x.json", "b/x.json", "a/free%20space.json", "a/keep.json"):
        (tmp_path / name).write_text(name)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).where("path not like '%keep%'").select("path")
    record, noise = f"{tmp_path}/record", tmp_path / "noise"
    assert quarantine.run(spark, listed, str(noise), record, dry_run=True) == {"planned": 3} and not noise.exists()
    quarantine.plan(listed, str(noise)).write.parquet(record)  # as if a run had been cut off after its first move
    first = spark.read.parquet(record).where("path like '%space%'").head()
    noise.mkdir()
    (tmp_path / "a" / "free%20space.json").rename(noise / "free%20space.json")
    assert first and quarantine.run(spark, listed.limit(0), str(noise), record) == {"done before": 1, "moved": 2}
    assert sorted(p.read_text() for p in noise.glob("*.json")) == ["a/free%20space.json", "a/x.json", "b/x.json"] and (tmp_path / "a" / "keep.json").exists()
    assert quarantine.run(spark, listed.limit(0), str(noise), record) == {"done before": 3}


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    calls = tmp_path / "calls"

    class Model:
        def __init__(self, good):
            self.good = good

        def extract(self, prompt):
            with open(calls, "a") as f:
                f.write(prompt[-1] + "\n")
            if prompt[-1] == "x":
                raise OSError("no route")
            return f'Sure: ```json\n{{"id": "{prompt[-1]}"}}\n```' if prompt[-1] in self.good else "cannot"

    rows = spark.createDataFrame([("a", "needs_extraction"), ("b", "needs_extraction"), ("x", "needs_extraction"), ("gone", "needs_extraction"), ("r", "ready")], "stem string, status string")
    texts = spark.createDataFrame([(s, "text of " + s) for s in "abxr"], "stem string, text string")
    told = lambda found: sorted((r.stem, r.model, r.outcome, r.json) for r in found.collect())
    first = extraction.run(spark, rows, texts, [("small", Model("a")), ("large", Model("a"))], str(tmp_path / "o"), delay=0)
    assert told(first) == [("a", "small", "ok", '{"id": "a"}'), ("b", None, "failed", None), ("gone", None, "no text", None), ("x", None, "failed", None)]
    calls.write_text("")
    second = extraction.run(spark, rows, texts, [("small", Model("")), ("large", Model("ab"))], str(tmp_path / "o"), delay=0)
    assert told(second) == [("a", "small", "ok", '{"id": "a"}'), ("b", "large", "ok", '{"id": "b"}'), ("gone", None, "no text", None), ("x", None, "failed", None)]
    assert sorted(calls.read_text().split()) == ["b", "b", "x", "x"], "what succeeded is not asked again"
    short = extraction.pending(rows, texts, second.limit(0), limit=4).where("stem = 'a'").head().prompt
    assert short.endswith("\ntext") and [extraction.parsed(x) for x in (None, "", "[1]", 'a {"b": {}} c', '{"x": 1}')] == [None, None, None, {"b": {}}, {"x": 1}]


def test_windowed_failures(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, h, m), "error" if m else "view") for h in range(3) for m in (0, 30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/e")
    streams.failure_rate(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.events, r.errors) for r in spark.table("rates").orderBy("start").collect()] == [(2, 1)] * 3


DISTRICT, PANEL = connectors.ADAPTERS["bsee"].listings


def stored(spark, pages):
    return connectors.Stored(spark.createDataFrame(list(pages.items()), "url string, content binary"))


@pytest.mark.parametrize("as_table", [False, True])
def test_connectors_over_stored_pages(spark, as_table):
    pages = {
        DISTRICT: b'<a href="/a/Fire-2019.pdf">Fire in 2019</a> <a href="https://o.example/b.pdf"><b>Spill</b></a> <a href="/gone.pdf"></a>',
        PANEL: b'<a href="/other/fire-2019.pdf">Again</a> <a class="x" href="/p/panel.PDF" >Panel</a>',
        "https://www.bsee.gov/a/Fire-2019.pdf": b"one", "https://o.example/b.pdf": b"two",
    }
    transport = stored(spark, pages) if as_table else connectors.Pages(pages)
    found = connectors.discover(spark, "bsee", transport)
    assert sorted((r.doc_id, r.title, r.url, r.date, r.page_url == PANEL) for r in found.collect()) == [
        ("b", "Spill", "https://o.example/b.pdf", None, False), ("fire-2019", "Fire in 2019", "https://www.bsee.gov/a/Fire-2019.pdf", "2019-01-01", False),
        ("gone", "gone", "https://www.bsee.gov/gone.pdf", None, False), ("panel", "Panel", "https://www.bsee.gov/p/panel.PDF", None, True),
    ]
    assert [r.doc_id for r in connectors.discover(spark, "bsee", transport, limit=2).collect()] == ["fire-2019", "b"]
    rows, contents = connectors.download(found.where("doc_id != 'panel'"), transport, tries=2)
    got = {r.incident_id: (r.downloaded, r.http_status, r.file_size_bytes, r.error) for r in rows.collect()}
    assert got == {"fire-2019": (True, 200, 3, None), "b": (True, 200, 3, None), "gone": (False, 404, None, "HTTP 404")} and contents.count() == 2
    with pytest.raises(ValueError, match="unknown source"):
        connectors.discover(spark, "nowhere", transport)

    class Failing:
        def get(self, url):
            raise OSError("no route")

    failed = connectors.fetch(spark.createDataFrame([("https://x",)], "url string"), Failing()).head()
    assert failed.error == "OSError" and failed.content is None


CSB = "https://www.csb.gov"
SITE = {
    f"{CSB}/investigations/completed-investigations/?pg=1": b'<a href="/big-fire/">x</a> <a href="/about/">a</a> <a href="/ab/">short</a> full investigation details <a href="/no-report/">y</a> Full Investigation  Details',
    f"{CSB}/investigations/completed-investigations/?pg=2": b'<a class="c" href="/pump-blast/"><h3> Pump blast </h3></a> <a href="/big-fire/"><h3>Big fire again</h3></a> <a href="/lost/"><h3>Lost</h3></a>',
    f"{CSB}/investigations/completed-investigations/?pg=3": b"<p>nothing more</p>",
    f"{CSB}/big-fire/": b'<h1>The <b>Big</b> Fire</h1> Final Report Released On:</strong> 03/04/2019 <a href="/file.aspx?DocumentId=7">Appendix A</a> <a href="/file.aspx?documentid=8">Report</a> <a href="/final_report.pdf">Final</a>',
    f"{CSB}/no-report/": b"<h1>None</h1>",
    f"{CSB}/pump-blast/": b'<p>On March 5, 2020 it blew.</p> <a href="/assets/recommendation/final_report.pdf">r</a> <a href="/a/report.pdf">one</a> <link href="/b/Final_Investigation.PDF"> <a href="/c/investigation_final.pdf">two</a>',
    f"{CSB}/file.aspx?documentid=8": b"<html>moved</html>",
    f"{CSB}/b/Final_Investigation.PDF": b"pdf",
}


@pytest.mark.parametrize("as_table", [False, True])
def test_crawl_of_listings_and_details(spark, tmp_path, as_table):
    """Two listing pages and their detail pages give the two best reports; a third page ends the listing; html is not downloaded."""
    transport = stored(spark, SITE) if as_table else connectors.Pages(SITE)
    found = connectors.discover(spark, "csb", transport, path=f"{tmp_path}/crawl")
    want = [("big-fire", "The Big Fire", "2019-03-04", f"{CSB}/big-fire/", f"{CSB}/file.aspx?documentid=8"), ("pump-blast", "Pump blast", "2020-03-05", f"{CSB}/pump-blast/", f"{CSB}/b/Final_Investigation.PDF")]
    assert sorted(map(tuple, found.select("doc_id", "title", "date", "page_url", "url").collect())) == want
    pages = crawl.pages(spark, f"{tmp_path}/crawl")
    assert sorted((r["round"], r.kind, r.url.removeprefix(CSB), r.error) for r in pages.collect()) == [
        (0, "listing", "/investigations/completed-investigations/?pg=1", None), (1, "detail", "/big-fire/", None), (1, "detail", "/no-report/", None), (1, "listing", "/investigations/completed-investigations/?pg=2", None),
        (2, "detail", "/lost/", "HTTP 404"), (2, "detail", "/pump-blast/", None), (2, "listing", "/investigations/completed-investigations/?pg=3", None),
    ]
    assert [r.doc_id for r in connectors.discover(spark, "csb", transport, limit=1).collect()] == ["big-fire"]
    rows, contents = connectors.download(found, transport)
    got = {r.incident_id: (r.downloaded, r.pdf_path, r.error) for r in rows.collect()}
    assert got == {"big-fire": (False, None, "Not a PDF: text/html"), "pump-blast": (True, "csb/pdfs/pump-blast.pdf", None)} and contents.count() == 1


def test_crawl_goes_on_where_it_stopped(spark, tmp_path):
    """Rounds that are written are not fetched again; one that was cut off is."""
    asked = []

    def run(path):
        adapter = connectors.ADAPTERS["csb"]
        seeds = spark.createDataFrame([(f"{adapter.listings[0]}?pg=1", "listing", 1, None, None)], crawl.FRONTIER)

        def fetch(urls):
            asked.append(sorted(r.url.removeprefix(CSB) for r in urls.collect()))
            return connectors.fetch(urls, connectors.Pages(SITE))

        return crawl.crawl(spark, seeds, fetch, lambda p: connectors.frontier_of(adapter, p), path)

    whole = run(f"{tmp_path}/a").count()
    assert len(asked) == 3 and whole == 7
    (tmp_path / "a" / "round=2" / "_SUCCESS").unlink()
    assert run(f"{tmp_path}/a").count() == whole and len(asked) == 4 and asked[3] == asked[2]
    assert run(f"{tmp_path}/a").count() == whole and len(asked) == 4


def test_other_publishers(spark):
    tsb, phmsa = (connectors.ADAPTERS[k].listings[0] for k in ("tsb", "phmsa"))
    pages = {
        tsb: b'<a href="/eng/reports/pipeline/2020/p20h0001/p20h0001.html">P20H0001 <i>leak</i></a> <td><span class="date">2020-01-02</span></td><a href="/eng/x.html">x</a> <a href="/eng/reports/pipeline/other.html">Other</a> <a href="/eng/reports/pipeline/2020/P20H0001/again.html">z</a><span class="big date"> 2021-02-03 </span>',
        phmsa: b'<a href="/data/a b.ZIP">All <b>data</b></a> <a href="/data/c.csv"></a> <a href="/data/c.csv">again</a> <a href="/x/c.csv">other</a> <a href="/x.pdf">no</a>',
    }
    got = sorted((r.doc_id, r.title, r.date) for r in connectors.discover(spark, "tsb", connectors.Pages(pages)).collect())
    assert got == [("OTHER", "Other", "2021-02-03"), ("P20H0001", "P20H0001 leak", "2020-01-02")]
    got = sorted((r.doc_id, r.title, r.url.removeprefix("https://www.phmsa.dot.gov")) for r in connectors.discover(spark, "phmsa", connectors.Pages(pages)).collect())
    assert got == [("a-b", "All data", "/data/a b.ZIP"), ("c", "c.csv", "/data/c.csv"), ("c", "other", "/x/c.csv")]
    rows, _ = connectors.download(connectors.discover(spark, "phmsa", connectors.Pages(pages)), connectors.Pages({"https://www.phmsa.dot.gov/data/c.csv": b"a"}))
    assert sorted((r.incident_id, r.downloaded) for r in rows.collect()) == [("a-b", False), ("c", False), ("c", True)]


def test_models_are_saved_with_what_they_need(spark, tmp_path):
    from hazardframe.operators import ml

    df = spark.createDataFrame([(k, float(k % 7), int(k % 7 > 3)) for k in range(70)], "id long, a double, y int")
    model = ml.logistic(["a"], "y").fit(ml.weighted(df, "y"))
    sinks.save_model(model, f"{tmp_path}/m", {"all_features": ["a"]}, df.limit(5))
    back, meta = sinks.load_model(spark, f"{tmp_path}/m")
    assert meta == {"all_features": ["a"]} and ml.predictions(back, ml.weighted(df, "y"), "id").count() == 70
    assert sinks.digests(spark, f"{tmp_path}/m/background").where("length(sha256) = 64").count() >= 1
    assert sinks.write_thresholds(spark, spark.sql("select 0.45d p60, 0.7d p80"), f"{tmp_path}/t") == {"p60": 0.45, "p80": 0.7}
    assert json.loads(sinks.read_text(spark, f"{tmp_path}/t")) == {"p60": 0.45, "p80": 0.7}
    sinks.write_raw(spark.createDataFrame([("1", "a\nb"), ("2", None)], "id string, t string"), f"{tmp_path}/raw", "id", "t")
    assert sorted(map(tuple, sinks.read_raw(spark, f"{tmp_path}/raw").fillna("-").collect())) == [("1", "a\nb"), ("2", "-")]
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n int")
    assert sinks.summary(counts, "k") == ["b: 3", "a: 1"] and sinks.markdown_report("T", {"facts": {"x": 1}, "rows": counts}).startswith("# T\n\n## facts\n\n- x: 1\n\n## rows\n\n| k | n |")


def test_configuration_and_older_layouts(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"types": {"ppe": {"display_name": "Gear"}, "x": {"display_name": "Y"}}, "plain": {"a": "b"}}))
    assert sorted(map(tuple, files.read_config(spark, str(tmp_path / "names.json"), "types").collect())) == [("ppe", "Gear"), ("x", "Y")]
    assert sorted(map(tuple, files.read_config(spark, {"a": "b"}).collect())) == [("a", "b")]
    assert files.read_processed(spark, str(tmp_path / "none")) == (None, files.NO_METRICS)
    (tmp_path / "old").mkdir()
    for k in (2, 1):
        (tmp_path / "old" / f"INC-{k}.json").write_text(json.dumps({"incident_id": f"INC-{k}"}))
    (tmp_path / "old" / "fleet_metrics.json").write_text('{"total_incidents": 2}')
    rows, found = files.read_processed(spark, str(tmp_path / "old"))
    assert [r.incident_id for r in rows.collect()] == ["INC-1", "INC-2"] and found == {"total_incidents": 2}
    assert files.read_bowtie(spark, str(tmp_path / "none.json")) is None and files.read_bowtie(spark, str(tmp_path / "names.json")) is None
    assert files.inspect_bulk(spark, str(tmp_path / "none.csv"))["error"]


def test_overview_and_details(spark, tmp_path, capsys):
    (tmp_path / "old").mkdir()
    one = {"incident_id": "INC-2", "title": "Leak", "description": "d" * 60, "location": "", "potential_severity": "high", "analytics": {"coverage": {"prevention_coverage": 0.5, "mitigation_coverage": 0.25}, "gaps": [{"missing_barrier_id": "B1", "type": "prevention"}, {"id": "x", "name": "PSV", "description": "none"}]}}
    for row in (one, {"incident_id": "INC-1", "description": "e" * 60}):
        (tmp_path / "old" / f"{row['incident_id']}.json").write_text(json.dumps(row))
    (tmp_path / "old" / "fleet_metrics.json").write_text('{"total_incidents": 2, "average_prevention_coverage": 0.125}')
    cli.main(["overview", "--input", str(tmp_path / "old"), "--output", str(tmp_path / "o"), "--source", "INC-2"])
    first, second = (json.loads(x) for x in capsys.readouterr().out.strip().splitlines()[-2:])
    assert first["figures"] == {"incidents": "2", "prevention": "12.5%", "mitigation": "0.0%", "overall": "0.0%"} and first["incidents"] == 2
    gaps = [{"type": "Prevention", "name": "B1", "description": "No description"}, {"type": "Unknown", "name": "PSV", "description": "none"}]
    assert second == {"incident_id": "INC-2", "title": "Leak", "description": "d" * 60, "date": "Unknown", "location": "Unknown", "severity": "high", "prevention": 0.5, "mitigation": 0.25, "gaps": gaps}
    rows, _ = files.read_processed(spark, str(tmp_path / "old"))
    assert [(r.label, r.prevention, r.n_gaps) for r in api.incident_list(rows).collect()] == [("INC-1 - " + "e" * 40, None, 0), ("INC-2 - Leak", 0.5, 2)]
    with pytest.raises(api.ServiceError):
        api.incident_details(rows, "INC-9")
    plain = rows.select("incident_id")
    assert api.incident_details(plain, "INC-1")["gaps"] == [] and api.incident_list(plain).count() == 2


def test_training_and_smoke_commands(spark, folder, capsys):
    from hazardframe.operators import cascade, ml

    rng = __import__("random").Random(1)
    rows = [(f"inc-{k // 6}", rng.choice("abc"), float(rng.randint(0, 5)), int(rng.random() < 0.5), int(rng.random() < 0.4)) for k in range(120)]
    pairs = spark.createDataFrame(rows, f"incident_id string, {cascade.CATEGORICAL[0]} string, {cascade.NUMERIC[0]} double, y_fail_target int, y_hf_fail_target int")
    pairs.write.parquet(str(folder / "pairs"))
    cli.main(["train", "--input", str(folder / "pairs"), "--output", str(folder / "t"), "--limit", "3"])
    assert set(json.loads(capsys.readouterr().out.strip().splitlines()[-1])["passed"]) == {"y_fail_target", "y_hf_fail_target"}
    assert "## y_hf_fail_target" in sinks.read_text(spark, str(folder / "t" / "cv_report")) and "Verdict: " in sinks.read_text(spark, str(folder / "t" / "y_fail_target" / "gate_report"))
    model, meta = sinks.load_model(spark, str(folder / "t" / "y_fail_target"))
    assert meta["target"] == "y_fail_target" and ml.score_targets(pairs, {"fail": model}, ["incident_id"]).where("risk_rank_fail = 1").count() >= 20
    text, passed = sinks.gate_report([0.8, 0.65])
    assert passed and "| 2 | 0.6500 |" in text and not sinks.gate_report([0.9, 0.5])[1] and not sinks.gate_report([0.9, None])[1] and not sinks.gate_report([])[1]
    cli.main(["associate-smoke", "--input", str(folder / "in"), "--output", str(folder / "s")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"controls": 2, "passed": True}
    (folder / "in2").mkdir()
    (folder / "in2" / "x.json").write_text("{}")
    with pytest.raises(SystemExit, match="no controls"):
        cli.main(["associate-smoke", "--input", str(folder / "in2"), "--output", str(folder / "s2")])


def test_aggregate_keeps_where_a_document_came_from(spark, folder):
    (folder / "in" / "list.json").write_text("[1]")
    (folder / "in" / ".hidden.json").write_text("{}")
    got = incidents.aggregated(incidents.read_json(spark, str(folder / "in"))).collect()
    assert [(r.incident_id, r.source_file.rsplit("/", 1)[1]) for r in got] == [("I-1", "one.json"), ("two", "two.json")]


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    class Model:
        def extract(self, prompt):
            calls.append(prompt)
            if len(calls) < 3:
                raise OSError
            return "ok"

    assert providers.Retrying(Model(), 2, waits.append).extract("p") == "ok" and waits == [1, 2]
    calls.clear()
    with pytest.raises(OSError):
        providers.Retrying(Model(), 1, waits.append).extract("p")


def test_commands_for_texts_and_sources(spark, folder, capsys):
    said = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    run = lambda *a: cli.main([*map(str, a)])
    run("quality-gate", "--input", folder / "in")
    gate = said()
    assert (gate["documents"], gate["has_controls"], gate["has_controls_pct"], gate["most"]) == (3, 1, 33.3, 3)
    (folder / "t").mkdir()
    (folder / "t" / "a.txt").write_text("ID: 1\nDescription: x\nPrevention Barriers: Valve, valve\nMitigation Barriers: Deluge\n\nID: 2\nDescription: y\n")
    (folder / "bowtie.json").write_text(json.dumps({"hazard": "h", "top_event": "t", "barriers": [{"id": "b1", "name": "VALVE", "type": "prevention"}, {"id": "b2", "name": "alarm", "type": "mitigation"}]}))
    run("process", "--input", folder / "t", "--output", folder / "p", "--other", folder / "bowtie.json")
    assert said() == {"incidents": 2, "prevention": 0.5, "mitigation": 0.0, "overall": 0.5}
    assert sorted(map(tuple, files.read_csv(spark, str(folder / "p" / "gaps")).collect())) == [("1", "mitigation", "alarm"), ("2", "mitigation", "alarm"), ("2", "prevention", "VALVE")]
    run("extract-text", "--input", folder / "t", "--output", folder / "x")
    assert said() == [{"extraction_status": "TOO_SHORT", "n": 1}]
    run("extract-structured", "--input", folder / "t", "--output", folder / "s")
    assert said()["top_errors"] == [{"error": "incident_id: Field required", "n": 1}]
    (folder / "pdfs").mkdir()
    for name in ("one.pdf", "free%20space.pdf"):
        (folder / "pdfs" / name).write_bytes(b"x")
    run("corpus-manifest", "--input", folder / "pdfs", "--other", folder / "in", "--output", folder / "c")
    assert said() == [{"status": "needs_extraction", "n": 1}, {"status": "ready", "n": 1}]
    run("corpus-clean", "--input", folder / "pdfs", "--other", folder / "in", "--output", folder / "c", "--dry-run")
    assert said() == {"noise": 2, "planned": 2}
    run("ingest-source", "--input", folder / "pdfs", "--output", folder / "i")
    assert said() == {"documents": 2} and spark.read.parquet(str(folder / "i" / "documents")).count() == 1
    (folder / "site").mkdir()
    listing = connectors.ADAPTERS["bsee"].listings[0]
    (folder / "site" / quote(listing, safe="")).write_text('<a href="/r/a.pdf">Fire</a>')
    (folder / "site" / quote("https://www.bsee.gov/r/a.pdf", safe="")).write_bytes(b"pdf")
    run("discover-source", "--source", "bsee", "--input", folder / "site", "--output", folder / "d")
    assert said() == {"source": "bsee", "candidates": 1}
    run("acquire", "--source", "bsee", "--input", folder / "site", "--output", folder / "q")
    assert said() == {"rows": 1, "downloaded": 1}
    (folder / "bulk.csv").write_text("REPORT_NUMBER,Narrative\n1,a\n2,b\n")
    run("ingest-phmsa", "--input", folder / "bulk.csv", "--output", folder / "b")
    assert said()["rows"] == 2
    run("overview", "--input", folder / "none")
    assert said()["incidents"] == 0


def test_command_line(spark, folder, capsys):
    cli.main(["build-combined-exports", "--input", str(folder / "in"), "--output", str(folder / "out")])
    assert files.read_csv(spark, str(folder / "out" / "controls")).count() == 2
    cli.main(["schema-check", "--input", str(folder / "in")])
    assert {"error": "document: not JSON", "n": 1} in json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    cli.main(["report", "--input", str(folder / "in"), "--output", str(folder / "r")])
    assert files.read_csv(spark, str(folder / "r" / "coverage")).count() == 2


def test_service(spark):
    b = spark.createDataFrame([(1, 1, "a", "prevention", "1st", 1, ["T1"]), (1, 2, "b", "mitigation", "2nd", 2, ["T1", "T2"]), (1, 3, "c", "mitigation", "2nd", 2, [])], "incident_id long, control_seq int, control_id string, side string, line_of_defense string, lod_numeric int, linked_threat_ids array<string>")
    t = spark.createDataFrame([(1, "T1", "Pump leak")], "incident_id long, threat_id string, threat_name string")
    score = lambda rows: rows.withColumn("p", F.when(F.col("control_id_target") == "b", 0.8).otherwise(0.5))
    got = [(r.control_id, r.band) for r in api.predict_cascading(b, t, "a", score).collect()]
    assert got == [("b", "HIGH"), ("c", "MEDIUM")]
    with pytest.raises(ValueError, match="not in the scenario"):
        api.predict_cascading(b, t, "zz", score)
    assert api.narrative_synthesis("p", providers.StubModel("Fine.")) == "Fine."

    class Broken:
        def extract(self, prompt):
            raise RuntimeError

    class Slow:
        def extract(self, prompt):
            time.sleep(1)

    for model, status in ((providers.StubModel("word " * 99), 502), (providers.StubModel(" "), 502), (None, 503), (Broken(), 503), (Slow(), 504)):
        with pytest.raises(api.ServiceError) as e:
            api.narrative_synthesis("p", model, 0.2)
        assert e.value.status == status
    with pytest.raises(api.ServiceError):
        api.check_route("predict")
    with pytest.raises(api.ServiceError):
        api.check_key("x", "y")
    api.check_key(None, None)
    prompt = api.synthesis_prompt("{top_event}|{shap_features_formatted}|{rag_contexts_formatted}", {"top_event": "leak"}, [("side", 0.5)], [("I", "s", "")])
    assert prompt == "leak|- side: +0.500|<rag_incident_contexts>Incident I: s</rag_incident_contexts>"
    assert api.health(model=object(), index=None)["status"] == "degraded"
