"""Plans: the operators put together into the runs a user starts.

``extract_signals`` reads the contents once per group of extractors and holds the small
results, so that everything after it works on rows instead of file contents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import chunks as C, classify, code, evidence as E, features as FT, manifests as M, modules as MO
from ..operators import quality as Q, repair, report as R, requirements as RQ, signals as S
from ..functions.paths import top_dir
from ..session import hold
from ..sources.files import drop_binary, scan_files


def extract(files: DataFrame) -> dict:
    """Extraction only: scan, classify, chunk, group into modules, check, and sum up."""
    scan = drop_binary(scan_files(files))
    classified = classify.classify_files(scan)
    chunk_ids = hold(C.chunk_lines(classified).select("repo", "path", "chunk_no", "chunk_id"))
    members = MO.module_files(chunk_ids)
    norm = MO.normalize_modules(members)
    validation = MO.validate_modules(norm, scan)
    records = classified.select("repo", "path", "ext", "size", "category", "confidence")
    return {"scan": scan, "classified": classified, "files": records, "chunks": chunk_ids, "members": members,
            "modules": norm, "validation": validation, "payload": MO.final_payload(records, chunk_ids, norm, validation)}


def module_overview(files: DataFrame) -> DataFrame:
    """The flagship query: every module with its size and the verdict on its repository."""
    scan = drop_binary(scan_files(files))
    per_file = classify.classify_files(scan).select("repo", "path", C.chunk_count(F.col("content")).alias("chunks")).filter("chunks > 0")
    rows = MO.normal_names(per_file.withColumn("module", top_dir(F.col("path"))))
    mods = rows.groupBy("repo", "name").agg(F.count("*").alias("n_files"), F.sum("chunks").alias("n_chunks"))
    check = MO.validate_modules(mods.withColumn("confidence", F.lit(1.0)), scan)
    return mods.join(check.select("repo", "score", "valid"), "repo")


def convert(payload: dict) -> dict:
    """Final record -> features, one requirement each, and a summary line."""
    feats = RQ.payload_features(payload["members"], payload["modules"], payload["validation"])
    return {"features": feats, "requirements": RQ.payload_requirements(feats),
            "requirement_modules": RQ.requirement_modules(payload["members"], feats),
            "summary": RQ.system_summary(payload["modules"], payload["scan"]),
            "gaps": MO.validation_issues(payload["modules"], payload["scan"])}


def gather_evidence(scan: DataFrame) -> dict:
    """Endpoints, RPCs, dependencies and the evidence record, from one pass over the contents."""
    slim = hold(E.relevant_contents(scan))
    endpoints, rpcs, deps = code.spring_endpoints(slim), code.proto_rpcs(slim), hold(M.dependencies(slim))
    ev = hold(E.evidence(slim, endpoints, rpcs, deps, M.build_facts(slim)))
    return {"endpoints": endpoints, "rpcs": rpcs, "deps": deps, "evidence": ev, "labels": E.stack_labels(deps, ev)}


def pack_features(scan: DataFrame) -> DataFrame:
    """All pack features from one scan of the contents, whose matches are held."""
    found = hold(S.tagged(scan))
    return FT.signal_features({
        "web_api": FT.web_features(S.http_contracts(found), S.auth_signals(found), S.middleware_signals(found)),
        "data_platform": FT.data_features(S.pipeline_definitions(found), S.orchestrators(found), S.data_sources(found), S.data_quality_checks(found)),
        "ml_pipeline": FT.ml_features(S.ml_stages(found), S.model_types(found)),
        "mobile_app": FT.mobile_features(S.app_screens(found), S.device_permissions(found), S.mobile_platforms(scan))})


def collect_features(ex: dict, found: dict) -> DataFrame:
    """Fallback features, calibrated, plus the features of activated packs, before they are validated."""
    base = hold(FT.fallback_features(ex["modules"]))
    base = FT.calibrate_confidence(base, FT.feature_sources(base), ex["classified"]).drop("source", "n_files", "n_negative")
    extra = pack_features(ex["scan"]).withColumn("ord", F.struct("pack", "family", "name"))
    scores = E.pack_score(ex["scan"], found["deps"], found["evidence"])
    active = extra.join(scores.select("repo", "pack"), ["repo", "pack"], "left_semi")
    return hold(FT.merge_skill_features(base, active))


def derive_features(ex: dict, found: dict) -> DataFrame:
    """All features of a repository, deduplicated, merged and numbered."""
    return FT.validate_features(collect_features(ex, found))


def report_tables(features: DataFrame, found: dict, repos: DataFrame, enrichment: DataFrame | None = None,
                  terms: DataFrame | None = None) -> dict:
    ev, labels = found["evidence"], found["labels"]
    frs = hold(RQ.functional_requirements(features))
    business = FT.business_context(features)
    return {"repos": repos, "frs": frs, "executive": R.executive_rows(features, business), "review": R.review_items(features),
            "summary": FT.product_summary(features), "capabilities": FT.capabilities(features), "scope": R.scope_and_goals(features),
            "inventory": R.layer_inventory(features), "stakeholders": R.stakeholder_rows(business),
            "requirements": RQ.requirement_table(features, frs, enrichment), "interfaces": R.interface_table(ev, found["endpoints"], found["rpcs"]),
            "nfrs": RQ.nonfunctional_requirements(labels, repos), "data": R.data_rows(ev, found["deps"]), "stack": R.stack_table(labels),
            "infra": R.infra_rows(ev, labels), "risks": R.risk_register(features, repos), "compliance": R.compliance_rows(ev),
            "issues": R.open_issues(features, labels, repos), "glossary": RQ.glossary(terms) if terms is not None else None}


def full_run(files: DataFrame, date: str) -> dict:
    """Everything: extraction, evidence, features, requirements, report and its repair."""
    ex = extract(files)
    found = gather_evidence(ex["scan"])
    feats = hold(derive_features(ex, found))
    repos = found["evidence"].select("repo")
    tables = report_tables(feats, found, repos)
    lines = hold(R.report_lines(tables, date))
    parts = R.render_report(lines)
    docs = hold(parts.select(F.col("repo").alias("doc_key"), "repo", "text"))
    repaired = repair.repair_loop(docs, feats, tables["frs"], found["evidence"])
    return {**ex, **found, "features": feats, **tables, "lines": lines, "parts": parts, "documents": repaired}
