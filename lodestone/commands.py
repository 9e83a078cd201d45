"""inspect, migrate and verify: driver-side control around the DataFrame operators."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import contracts, policy
from .errors import CAPABILITY, FORWARD, OK, REFUSED_INPUT, REQUEST, SHAPE, WARNINGS, PolicyRefusal, Refusal, Unsupported
from .operators import dispatch, lowering, store, verify as checks
from .operators.detect import Artifact, as_table, detect
from .functions import values as v
from .schemas import PRESERVABLE
from .sources.documents import native_rows
from .sources.filetree import copy, scan


def _text(doc: dict[str, Any]) -> str:
    lines = [f"{doc['source']}: {doc['status']}"]
    for a in doc["input_inventory"]:
        lines.append(f"  {a['path']}  {a['source_kind']}  version {a['detected_version']}" + (f"  ({a['note']})" if a["note"] else ""))
    return "\n".join(lines)


def inspect(spark: SparkSession, source: str, form: str = "json", report: str | None = None) -> int:
    """Prints what a source holds, and writes it to report; the source is only read."""
    policy.require_outside(source, report)
    with policy.guarded(spark, source):
        found = detect(source)
    known = any(a.kind != "unknown" for a in found)
    doc = contracts.inspection(source, found, "success" if known else "unsupported_input")
    contracts.write(report, doc)
    print(json.dumps(doc, indent=2, sort_keys=True) if form == "json" else _text(doc))
    return OK if known else REFUSED_INPUT


def _paths(output: str, given: dict[str, str | None], dry: bool) -> dict[str, str | None]:
    """Where the four documents go: into the output unless said otherwise; a dry run writes only what was asked for."""
    return {k: given.get(k) or (None if dry else os.path.join(output, name)) for k, name in contracts.NAMES.items()}


def _entry(a: Artifact, e: Refusal | None, disposition: str) -> dict[str, Any]:
    reason = str(e) if e else "lowering of this kind is not supported"
    return {"item": a.path, "source_kind": a.kind, "reason": reason, "disposition": disposition, "cause": e.cause if e else CAPABILITY}


def plan(spark: SparkSession, found: list[Artifact]) -> tuple[str, Artifact | None]:
    """(how, main artifact): the one lowering that a source's artifacts allow, or keeping all of them."""
    rows = dispatch.plans(as_table(spark, found).withColumn("root", F.lit(".")))
    best = rows.orderBy(F.desc("main"), "seq").first()
    if best.plan == "refuse":
        raise Unsupported("nothing known was found in the source", SHAPE) if best.refusal == "nothing_known" else Unsupported("an artifact has a newer version than is supported", FORWARD)
    return best.plan, found[best.seq] if best.main else None


def lower(spark: SparkSession, source: str, how: str, main: Artifact, found: list[Artifact]) -> lowering.Lowered:
    """The lowering of a plan; refuses if a rule is broken by the source as a whole."""
    now = contracts.now()
    at = source if main.path == "." else os.path.join(source, main.path)
    if how == "store":
        return lowering.lower_store(spark, at, now)
    if how == "native":
        manifest, path = lowering.native_manifest(at)
        rows = native_rows(spark, path)
        said = manifest.get("num_predictions")
        if isinstance(said, int) and said != rows.count():
            raise Unsupported("the manifest says another number of predictions", SHAPE)
        out = lowering.lower_native(rows, manifest, now)
    else:
        loose = next((a.details["files"] for a in found if a.kind == "loose-predictions"), None)
        if how == "run":
            manifest, _, name = lowering.legacy_run(source, main.path, loose)
            rows = lowering.read_loose(spark, source, [name])
        else:
            names = [f for f in loose or [] if f.endswith("_predictions.json")]
            if len(names) != 1:
                raise Unsupported(f"one predictions file is supported, there are {len(names)}", CAPABILITY)
            manifest, rows = None, lowering.read_loose(spark, source, names)
        out = lowering.lower_loose(rows, now)
        broken = lowering.violations_of(out.records)
        if not broken and manifest is not None and (other := lowering.disagreement(rows, manifest)):
            raise Unsupported(f"the run manifest and the predictions differ in: {', '.join(other)}", SHAPE)
    if broken := lowering.violations_of(out.records):
        raise Unsupported("; ".join(lowering.told(broken)), SHAPE, rules=list(broken))
    return out


def _keep(spark: SparkSession, source: str, output: str, items: list[Artifact], doc: dict[str, Any], why: Refusal | None) -> None:
    """Copies artifacts as they are and enters them in the ledger."""
    for a in items:
        at = source if a.path == "." else os.path.join(source, a.path)
        name = os.path.basename(os.path.normpath(source)) if a.path == "." else a.path
        rel = f"{store.PRESERVED}/{a.kind}/{name}"
        tree = scan(spark, at)
        names = a.details.get("files") if a.kind == "loose-predictions" else ["manifest.json", "score_set.json", "predictions.parquet"] if a.kind == "native-results-v1" and a.path == "." else None
        if names is not None:
            tree = tree.where(F.col("rel_path").isin(names))
        single = os.path.isfile(at)
        files = {r.rel_path: r.sha256 for r in copy(tree, at, output, os.path.dirname(rel) if single else rel).collect()}
        digest = next(iter(files.values()), "") if single else v.PREFIX + _sha(v.canonical(files, True))
        doc["checksums"] |= files
        doc["preserved_opaque"].append({"path": rel, "source_kind": a.kind, "checksum": digest})
        doc["unsupported"].append(_entry(a, why, "preserved"))
        doc["output_inventory"].append(contracts.output_entry(rel, {"files": len(files)}))


def _sha(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def migrate(
    spark: SparkSession, source: str, output: str, target: str = contracts.TARGET, strict: bool = False, dry_run: bool = False, copy_only: bool = False, verify_after: bool = False,
    resume: bool = False, checksums: str = "sha256", load_joblib: bool = False, **documents: str | None,
) -> int:
    """Lowers a source into output, keeps what it cannot lower (or refuses, if strict), and writes the four documents.

    documents: manifest, report, id_map, unsupported: where to write them instead of into output.
    """
    if target != contracts.TARGET or checksums != "sha256" or load_joblib or strict and copy_only or dry_run and copy_only:
        raise PolicyRefusal("this target or combination of options is not supported", REQUEST)
    policy.require_disjoint(source, output)
    paths = _paths(output, documents, dry_run)
    for p in paths.values():
        policy.require_outside(source, p)
    with policy.guarded(spark, source) as tree:
        found = detect(source)
        how, main = plan(spark, found)
        doc = contracts.manifest(source, policy.fingerprint(tree), found)
        if dry_run:
            return _dry(spark, source, found, how, main, doc, paths)
        policy.require_available(output, resume)
        made, parent = not os.path.exists(output), os.path.dirname(os.path.abspath(output))
        os.makedirs(parent, exist_ok=True)
        stage = tempfile.mkdtemp(prefix=".lodestone-", dir=parent)  # a new folder of its own, on the output's file system
        try:
            code, rep = _run(spark, source, stage, found, how, main, doc, strict, copy_only)
            rep["target_summary"]["path"] = output
            if rep["recommended_next_command"]:
                rep["recommended_next_command"] = f"lodestone verify {output} --manifest {paths['manifest']}"
            doc["tool"]["completed_at"] = contracts.now()
            _forget_previous(output)
            _move(stage, output)  # the documents are written last, into the output itself
            failed = None
            if verify_after:
                rep["verification_summary"] = checks.summary(spark, output, doc, list(contracts.NAMES.values()))
                failed = not rep["verification_summary"]["passed"]
            for k, payload in (("manifest", doc), ("report", rep), ("id_map", doc["old_to_new_ids"]), ("unsupported", contracts.unsupported_report(doc, rep))):
                contracts.write(paths[k], payload)
            if failed:
                checks.require(rep["verification_summary"])
            return code
        except Exception:
            if made:
                shutil.rmtree(output, ignore_errors=True)
            raise
        finally:
            shutil.rmtree(stage, ignore_errors=True)


def _forget_previous(output: str) -> None:
    """Removes the files that the manifest of an earlier, resumed run lists in output, and nothing else."""
    try:
        with open(os.path.join(output, contracts.NAMES["manifest"]), encoding="utf-8") as f:
            listed = list(json.load(f)["checksums"])
    except (OSError, ValueError, KeyError, TypeError):
        return
    top = os.path.realpath(output)
    for rel in listed:
        path = os.path.realpath(os.path.join(top, rel))
        if path.startswith(top + os.sep) and os.path.isfile(path):
            os.remove(path)


def _move(stage: str, output: str) -> None:
    """Moves the files below stage to the same places below output."""
    for top, _, files in os.walk(stage):
        to = os.path.normpath(os.path.join(output, os.path.relpath(top, stage)))
        os.makedirs(to, exist_ok=True)
        for name in files:
            os.replace(os.path.join(top, name), os.path.join(to, name))


def _dry(spark: SparkSession, source: str, found: list[Artifact], how: str, main: Artifact | None, doc: dict, paths: dict) -> int:
    why, lowered = None, [] if main is None else [a for a in found if a is main or how == "run"]
    if main is not None:
        try:
            lowered_rows = lower(spark, source, how, main, found)
            if how == "store" and (broken := lowering.violations_of(lowered_rows.records)):
                doc["warnings"] += lowering.told(broken)
        except Unsupported as e:
            why, lowered = e, []
    doc["unsupported"] = [_entry(a, why, "would_preserve") for a in found if a not in lowered and a.kind in PRESERVABLE]
    rep = contracts.report("migrated_with_warnings" if doc["unsupported"] else "success", None, doc["source"]["kinds"], found)
    rep["recommended_next_command"] = f"lodestone migrate {source} --output OUTPUT"
    rep["unsupported_counts"]["preserved"] = len(doc["unsupported"])
    for k, payload in (("manifest", doc), ("report", rep), ("unsupported", contracts.unsupported_report(doc, rep))):
        contracts.write(paths[k], payload)
    print(json.dumps(rep, indent=2, sort_keys=True))
    return OK


def _run(spark: SparkSession, source: str, output: str, found: list[Artifact], how: str, main: Artifact | None, doc: dict, strict: bool, copy_only: bool) -> tuple[int, dict]:
    if copy_only:
        files = copy(scan(spark, source), source, output, "payload").collect()
        doc["checksums"] = {r.rel_path: r.sha256 for r in files}
        doc["target"]["kind"] = "copy-only"
        doc["output_inventory"] = [contracts.output_entry("payload", {"files": len(files)})]
        return OK, contracts.report("success", None, doc["source"]["kinds"], found)
    lowered, why, arrays = lowering.Lowered(), None, 0
    if main is not None:
        try:
            lowered = lower(spark, source, how, main, found)
        except Unsupported as e:
            if strict or "not_finite" in e.rules and how in ("loose", "native"):
                raise
            why, main = e, None
    kept = [a for a in found if a is not main and not (how == "run" and main is not None) and (a.kind in PRESERVABLE)]
    if strict and kept:
        raise Unsupported("strict: " + ", ".join(f"{a.path} ({a.kind})" for a in kept) + " cannot be lowered", CAPABILITY)
    counts = store.create(spark, output, lowered.tables)
    written = scan(spark, os.path.join(output, store.STORE)).where("kind = 'file'").select("rel_path", "sha256").collect()
    doc["checksums"] = {f"{store.STORE}/{r.rel_path}": r.sha256 for r in written}
    doc["output_inventory"] = [contracts.store_entry(store.STORE, counts)]
    if lowered.records is not None:
        try:
            digests, listed = store.write_arrays(lowered.records, output)
            doc["checksums"] |= digests
            doc["output_inventory"] += listed
            arrays = sum(k.startswith(checks.ROWS) for k in digests)
        except Unsupported as e:
            if strict or how != "store":
                raise
            why = e
            doc["unsupported"].append({"item": f"{main.path}:prediction_arrays", "source_kind": main.kind, "reason": str(e), "disposition": "preserved_as_lines", "cause": e.cause})
        if how == "store":
            rel = f"{store.PRESERVED}/prediction_arrays.jsonl"
            doc["checksums"] |= store.write_lines(lowering.preserved_lines(lowering.legacy_rows(spark, os.path.join(source, main.path))), output, rel)
    _keep(spark, source, output, kept + ([a for a in found if how == "run" and main is not None] if how == "run" else []), doc, why)
    incomplete = bool(kept) or why is not None
    rep = contracts.report("migrated_with_warnings" if incomplete else "success", None, doc["source"]["kinds"], found)
    rep["preserved_counts"]["n4a"] = sum(u["source_kind"] in ("n4a-bundle", "n4a-py-bundle") for u in doc["preserved_opaque"])
    rep["recommended_next_command"] = "verify"  # migrate() fills in the paths
    rep["migrated_counts"] |= {k: n for k, n in counts.items() if k in rep["migrated_counts"]} | {"arrays": arrays}
    rep["unsupported_counts"]["preserved"] = sum(u["disposition"] == "preserved" for u in doc["unsupported"])
    return WARNINGS if incomplete else OK, rep


def verify(spark: SparkSession, output: str, manifest: str, report: str | None = None) -> int:
    """Checks an output against its manifest; the report is written before a failure is raised."""
    try:
        with open(manifest, encoding="utf-8") as f:
            doc = json.load(f)
        if not isinstance(doc, dict):
            raise ValueError("not an object")
    except (OSError, ValueError) as e:
        raise Unsupported("the manifest cannot be read", SHAPE) from e
    inside = [os.path.relpath(p, output) for p in (manifest, report) if p is not None]
    found = checks.summary(spark, output, doc, [*contracts.NAMES.values(), *inside])
    rep = contracts.report("success" if found["passed"] else "verification_failed", output, doc.get("source", {}).get("kinds", []))
    rep["verification_summary"] = found
    contracts.write(report, rep)
    print(json.dumps(rep, indent=2, sort_keys=True))
    checks.require(found)
    return OK
