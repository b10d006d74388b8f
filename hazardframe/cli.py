"""Command line: python -m hazardframe.cli <command> (Q7-Q13, Q15)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import api, session
from .functions import text
from .operators import baseline, cascade, coercion, coverage, manifests, mining, ml, profiling, providers, taxonomy, validation
from .schemas import MANIFEST
from .sources import connectors, extraction, files, incidents, quarantine, sinks


def _documents(spark, args):
    return incidents.read_json(spark, args.input)


def flatten(spark, args):
    parsed = _documents(spark, args)
    sinks.write_csv(incidents.flat_incidents(parsed), f"{args.output}/flat_incidents")
    sinks.write_csv(incidents.flat_controls(parsed), f"{args.output}/controls")


def report(spark, args):
    controls = incidents.flat_controls(_documents(spark, args))
    covered = coverage.coverage(controls, _documents(spark, args).where("v is not null").select("incident_id"))
    gap_rows = coverage.gaps(controls)
    for name, df in (("coverage", covered), ("gaps", gap_rows), ("rollups", coverage.gap_rollups(gap_rows)), ("status", baseline.status_distribution(controls)), ("cofailures", baseline.cofailures(controls))):
        sinks.write_csv(df, f"{args.output}/{name}")


def schema_check(spark, args):
    errors = validation.validation_errors(_documents(spark, args))
    print(json.dumps(sinks.report(errors.groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error"))))


def convert_schema(spark, args):
    parsed = _documents(spark, args)
    sinks.write_parquet(coercion.coerced_controls(parsed), f"{args.output}/controls")
    print(json.dumps(sinks.report(coercion.coercion_counts(parsed))))


def extract_qc(spark, args):
    texts = files.read_texts(spark, args.input)
    m = texts.select("stem", *[c.alias(n) for n, c in text.text_metrics(F.col("text")).items()])
    gated = m.withColumn("status", text.extraction_status(F.col("text_len"), F.col("alpha_ratio"), F.col("cid_count"), F.col("cid_ratio")))
    sinks.write_csv(gated, f"{args.output}/extraction_manifest")
    print(json.dumps(sinks.report(gated.groupBy("status").agg(F.count("*").alias("n")).orderBy("status"))))


def merge_manifests(spark, args):
    a, b = (files.read_manifest(spark, p, MANIFEST) for p in (args.input, args.other))
    sinks.write_manifest(manifests.merge(a, b), f"{args.output}/manifest")


def associate(spark, args):
    known = taxonomy.Taxonomy.load(args.other)
    controls = incidents.flat_controls(_documents(spark, args))
    side = taxonomy.side_of(F.col("side"))
    named = controls.withColumn("family", known.family(F.col("name"), F.col("barrier_role"), side, F.col("barrier_type")))
    sinks.write_csv(mining.association_rules(mining.failed_items(named)), f"{args.output}/rules")


def profile(spark, args):
    controls = incidents.flat_controls(_documents(spark, args))
    labelled = profiling.labels(profiling.known(controls))
    parts = {"Labels": profiling.label_stats(labelled), "Nulls": profiling.null_profile(controls, ["barrier_status", "side", "barrier_type", "line_of_defense"]), "Statuses": baseline.status_distribution(controls)}
    sinks.write_text(spark, f"{args.output}/profile", sinks.markdown_report("Profile of controls", parts))
    print(json.dumps(sinks.report(parts["Labels"])))


def process(spark, args):
    """Text incidents with, given a reference bowtie, their coverage, gaps and fleet metrics."""
    rows = files.text_blocks(files.read_texts(spark, args.input))
    sinks.write_parquet(rows, f"{args.output}/incidents")
    bowtie = files.read_bowtie(spark, args.other) if args.other else None
    if bowtie is None:
        return
    stored = spark.read.parquet(f"{args.output}/incidents")
    sides = [(c, s) for c, s in (("prevention_barriers", "prevention"), ("mitigation_barriers", "mitigation"))]
    present = None
    for column, side in sides:
        part = stored.select("incident_id", F.lit(side).alias("side"), F.explode(column).alias("name"))
        present = part if present is None else present.unionByName(part)
    covered = baseline.fleet_coverage(present, bowtie.select("side", "name"), stored.select("incident_id"))
    sinks.write_csv(covered, f"{args.output}/coverage")
    sinks.write_csv(baseline.fleet_gaps(present, bowtie.select("side", "name"), stored), f"{args.output}/gaps")
    means = sinks.report(baseline.fleet_means(covered))[0]
    sinks.write_text(spark, f"{args.output}/fleet_metrics", json.dumps(means))
    print(json.dumps(means))


def quality_gate(spark, args):
    print(json.dumps(sinks.report(coercion.quality_gate(coercion.gate_facts(_documents(spark, args)).drop("incident_id")))[0]))


def extract_text(spark, args):
    """Texts of documents by the chain of extractors, with their gate, as a manifest and a table of texts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.input)
    found = files.fallback_text(raw, files.EXTRACTORS, list(files.EXTRACTORS)).withColumn("text", text.normalize_text(F.col("text")))
    m = found.select("*", *[c.alias(n) for n, c in text.text_metrics(F.col("text")).items()])
    gated = m.withColumn("extraction_status", text.extraction_status(F.col("text_len"), F.col("alpha_ratio"), F.col("cid_count"), F.col("cid_ratio")))
    sinks.write_parquet(gated, f"{args.output}/texts")
    stored = spark.read.parquet(f"{args.output}/texts")
    sinks.write_csv(stored.drop("text"), f"{args.output}/text_manifest")
    print(json.dumps(sinks.report(stored.groupBy("extraction_status").agg(F.count("*").alias("n")).orderBy("extraction_status"))))


def extract_structured(spark, args, model=None):
    """Incident JSON from texts by a language model; answers are parsed leniently and checked against the schema.

    Without a model of the caller's a stub answers, so the run can be tried offline.
    """
    model = model or providers.StubModel("{}")
    texts = files.read_texts(spark, args.input)
    prompts = texts.select(F.col("stem").alias("incident_id"), text.fill_template("Extract the incident as JSON.\n{{text}}", text=text.truncated(F.col("text"), 50_000)).alias("prompt"))

    def run(frames):
        for frame in frames:
            yield frame.assign(answer=[model.extract(p) for p in frame["prompt"]])[["incident_id", "answer"]]

    sinks.write_parquet(prompts.mapInPandas(run, "incident_id string, answer string"), f"{args.output}/answers")
    parsed = coercion.json_in_answer(spark.read.parquet(f"{args.output}/answers"), "answer")
    checked = validation.validity(coercion.parse(parsed.select("incident_id", F.col("json").alias("payload"))))
    sinks.write_parquet(checked, f"{args.output}/structured_manifest")
    stored = spark.read.parquet(f"{args.output}/structured_manifest")
    print(json.dumps({**sinks.report(coercion.run_report(stored))[0], "top_errors": sinks.report(coercion.top_errors(stored))}))


def corpus_extract(spark, args, models=None):
    """Forms for the documents of a manifest (--other: stem, status) that need one, from the texts under --input, by a ladder of models; resumable.

    models: (name, model) in order of cost; without them nothing can be extracted, and that is said.
    """
    if not models:
        raise SystemExit("corpus-extract needs language models: call cli.corpus_extract(spark, args, models)")
    rows = files.read_csv(spark, args.other)
    found = extraction.run(spark, rows, files.read_texts(spark, args.input), models, args.output, args.delay, args.text_limit)
    print(json.dumps(sinks.report(found.groupBy("outcome").agg(F.count("*").alias("n")).orderBy("outcome"))))


def _stems(spark, folder, pattern):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(text.unquote(text.file_stem(F.col("path"))).alias("stem")).distinct()


def corpus_manifest(spark, args):
    """Which documents (--input) have a form (--other)."""
    documents, forms = _stems(spark, args.input, "*.pdf"), _stems(spark, args.other, "*.json")
    found = manifests.corpus(documents, forms, documents.limit(0))
    sinks.write_csv(found.orderBy("stem"), f"{args.output}/corpus_manifest")
    print(json.dumps(sinks.report(found.groupBy("status").agg(F.count("*").alias("n")).orderBy("status"))))


def corpus_clean(spark, args):
    """Forms (--other) without a document (--input): listed, and moved to the noise folder of --output unless it is a dry run."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(args.other)
    forms = listed.select("path", text.unquote(text.file_stem(F.col("path"))).alias("stem"))
    found = manifests.noise(forms, _stems(spark, args.input, "*.pdf"))
    sinks.write_csv(found.orderBy("stem"), f"{args.output}/noise")
    stored = files.read_csv(spark, f"{args.output}/noise")
    n = stored.count()
    done = quarantine.run(spark, forms.join(stored, "stem", "left_semi"), f"{args.output}/structured_json_noise", f"{args.output}/noise_moves", args.dry_run)
    print(json.dumps({"noise": n, **done}))


def _transport(spark, args):
    """Stored pages under --input stand for the publishers': a file's name is its quoted address. Tasks read them, from any store."""
    return connectors.Stored.folder(spark, args.input)


def discover_source(spark, args):
    found = connectors.discover(spark, args.source, _transport(spark, args), limit=args.limit)
    sinks.write_url_lists(found, args.output)
    print(json.dumps({"source": args.source, "candidates": found.count()}))


def acquire(spark, args):
    """Candidates of a source, their documents, and a manifest merged with the one before (--other)."""
    transport = _transport(spark, args)
    rows, contents = connectors.download(connectors.discover(spark, args.source, transport, limit=args.limit), transport)
    sinks.write_parquet(contents, f"{args.output}/documents")
    merged = manifests.merge(files.read_manifest(spark, args.other, MANIFEST), rows) if args.other else rows
    sinks.write_manifest(merged, f"{args.output}/manifest")
    stored = files.read_manifest(spark, f"{args.output}/manifest", MANIFEST)
    print(json.dumps(sinks.report(stored.agg(F.count("*").alias("rows"), F.count_if("downloaded").alias("downloaded")))[0]))


def ingest_source(spark, args):
    """Local documents: copied into a table, with a manifest, merged with the one before (--other)."""
    rows = files.ingest_documents(spark, args.input, f"{args.output}/documents", args.source or "local")
    merged = manifests.merge(files.read_manifest(spark, args.other, MANIFEST), rows) if args.other else rows
    sinks.write_manifest(merged, f"{args.output}/manifest")
    print(json.dumps({"documents": rows.count()}))


def ingest_phmsa(spark, args):
    """What a bulk table holds; its manifest has a header and no rows until its columns are confirmed."""
    found = files.inspect_bulk(spark, args.input, args.limit)
    sinks.write_csv(spark.createDataFrame([], ", ".join(f"{c} string" for c in files.BULK_MANIFEST)), f"{args.output}/manifest", single=True)
    print(json.dumps(found))


def overview(spark, args):
    """Key figures and the incidents of a folder that `process` or an older run wrote, and with --source the details of one incident."""
    rows, metrics_ = files.read_processed(spark, args.input)
    shown = api.key_figures(metrics_)
    if rows is None:
        print(json.dumps({**metrics_, "incidents": 0, "figures": shown}))
        return
    listed = api.incident_list(rows)
    sinks.write_csv(listed, f"{args.output}/incidents")
    print(json.dumps({**metrics_, "incidents": listed.count(), "figures": shown}))
    if args.source:
        print(json.dumps(api.incident_details(rows, args.source)))


def train(spark, args):
    """Cascade models of a table of pairs (--input), saved with metadata, and their cross-validation and gate reports."""
    pairs, models = spark.read.parquet(args.input), {}
    for target in [f"{y}_target" for y in cascade.TARGETS if f"{y}_target" in pairs.columns]:
        categorical, numeric = ([c for c in names if c in pairs.columns] for names in (cascade.CATEGORICAL, cascade.NUMERIC))
        model, models[target] = ml.train_cascade(pairs, categorical, numeric, target, rounds=args.limit or 400)
        sinks.save_model(model, f"{args.output}/{target}", models[target], ml.background(pairs.select(*categorical, *numeric)))
    sinks.write_text(spark, f"{args.output}/cv_report", sinks.cv_report(models))
    passed = {}
    for target, meta in models.items():
        text_, passed[target] = sinks.gate_report(meta["cv_scores"]["per_fold"])
        sinks.write_text(spark, f"{args.output}/{target}/gate_report", text_)
    print(json.dumps({"passed": passed}))


def associate_smoke(spark, args):
    """Runs the association steps on the incidents under --input and checks what each must give; --other is a taxonomy file."""
    parsed = _documents(spark, args)
    one = incidents.flat_controls(parsed)
    known = taxonomy.Taxonomy.load(args.other) if args.other else taxonomy.Taxonomy()
    side = taxonomy.side_of(F.col("side"))
    named = one.select("incident_id", "control_id", side.alias("barrier_level"), known.family(F.col("name"), F.col("barrier_role"), side, F.col("barrier_type")).alias("barrier_family"))
    sinks.write_csv(named, f"{args.output}/normalized")
    stored = files.read_csv(spark, f"{args.output}/normalized")
    n, strange, empty = stored.agg(F.count("*"), F.count_if(~F.coalesce(F.col("barrier_level").isin("prevention", "mitigation"), F.lit(False))), F.count_if(F.coalesce("barrier_family", F.lit("")) == "")).head()
    problems = [what for what, bad in (("no document", incidents.aggregated(parsed).isEmpty()), ("no controls", not n), (f"{strange} levels that are neither prevention nor mitigation", strange), (f"{empty} controls without a family", empty)) if bad]
    if problems:
        raise SystemExit("; ".join(problems))
    print(json.dumps({"controls": n, "passed": True}))


COMMANDS = {
    "process": process, "build-combined-exports": flatten, "report": report, "schema-check": schema_check, "convert-schema": convert_schema, "quality-gate": quality_gate,
    "extract-text": extract_text, "extract-qc": extract_qc, "extract-structured": extract_structured, "corpus-extract": corpus_extract, "corpus-manifest": corpus_manifest, "corpus-clean": corpus_clean,
    "acquire": acquire, "discover-source": discover_source, "ingest-source": ingest_source, "ingest-phmsa": ingest_phmsa, "merge-manifests": merge_manifests,
    "associate": associate, "associate-smoke": associate_smoke, "profile": profile, "overview": overview, "train": train,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hazardframe")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", default="out")
    parser.add_argument("--other", help="the second manifest, the forms, the reference bowtie or the taxonomy file")
    parser.add_argument("--source", help="the publisher")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--dry-run", action="store_true", help="say what would be moved")
    parser.add_argument("--delay", type=float, default=30.0, help="seconds between a task's calls of a model")
    parser.add_argument("--text-limit", type=int, default=50_000, help="characters of a text that a prompt holds; 0 for all")
    args = parser.parse_args(argv)
    COMMANDS[args.command](session.session(), args)


if __name__ == "__main__":
    main()
