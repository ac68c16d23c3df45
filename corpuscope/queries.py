"""Registered queries: every operator over the whole corpus built from the given tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions import paths as PA, text as TX
from .operators import chunks as C, classify as CL, code as CO, evidence as E, features as FT, learn as L
from .operators import manifests as M, modules as MO, numbering as N, quality as Q, repair as RP, report as R
from .operators import requirements as RQ, signals as S
from .plans import analyze as A
from .rules import signals as SR
from .session import hold
from .rules.languages import REGISTRY
from .sources import corpus, files as FS, registry as RG

DATE = "January 01, 2026"


class Tables:
    """Tables a query starts from; made on demand for one (spark, sf_dir)."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf = spark, sf_dir
        self._made = {}

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def files(self):
        return self._once("files", lambda: corpus.corpus_files(self.spark, self.sf))

    @property
    def web(self):
        return self._once("web", lambda: corpus.web_files(self.spark, self.sf))

    @property
    def scan(self):
        return self._once("scan", lambda: FS.drop_binary(FS.scan_files(self.files)))

    @property
    def classified(self):
        return self._once("classified", lambda: CL.classify_files(self.scan))

    @property
    def chunks(self):
        return self._once("chunks", lambda: C.chunk_lines(self.classified))

    @property
    def members(self):
        return self._once("members", lambda: MO.module_files(self.chunks.select("repo", "path")))

    @property
    def modules(self):
        return self._once("modules", lambda: MO.normalize_modules(self.members))

    @property
    def repos(self):
        return self._once("repos", lambda: self.scan.select("repo").distinct())

    @property
    def slim(self):
        return self._once("slim", lambda: hold(E.relevant_contents(self.scan)))

    @property
    def deps(self):
        return self._once("deps", lambda: M.dependencies(self.slim))

    @property
    def evidence(self):
        return self._once("evidence", lambda: E.evidence(
            self.slim, CO.spring_endpoints(self.slim), CO.proto_rpcs(self.slim), self.deps, M.build_facts(self.slim)))

    @property
    def labels(self):
        return self._once("labels", lambda: E.stack_labels(self.deps, self.evidence))

    @property
    def seed(self):
        """The features of the run, before they are deduplicated and merged."""
        return self._once("seed", lambda: A.collect_features({"modules": self.modules, "classified": self.classified, "scan": self.scan},
                                                             {"deps": hold(self.deps), "evidence": hold(self.evidence)}))

    @property
    def features(self):
        return self._once("features", lambda: hold(FT.validate_features(self.seed)))

    @property
    def frs(self):
        return self._once("frs", lambda: hold(RQ.functional_requirements(self.features)))

    @property
    def docs(self):
        return self._once("docs", lambda: corpus.report_docs(self.spark, self.sf))

    @property
    def fallback(self):
        return self._once("fallback", lambda: hold(FT.fallback_features(self.modules)))

    @property
    def validation(self):
        return self._once("validation", lambda: MO.validate_modules(self.modules, self.scan))

    @property
    def payload(self):
        return self._once("payload", lambda: hold(RQ.payload_features(self.members, self.modules, self.validation)))

    @property
    def pack_feats(self):
        return self._once("pack", lambda: A.pack_features(self.scan))


def tidy(df: DataFrame) -> DataFrame:
    """Counters as bigint, so that both engines report the same types."""
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
                       else F.col(f.name) for f in df.schema.fields])


QUERIES = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(Tables(spark, sf_dir)))
    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


# ---- scans and classification ------------------------------------------------------------------

@query
def module_overview(t):
    return A.module_overview(t.files)


@query
def scan_files(t):
    return FS.scan_files(t.files).select("repo", "path", "ext", "size", F.md5("content").alias("digest"))


@query
def drop_binary(t):
    return FS.drop_binary(t.files).groupBy("repo", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query
def read_with_limits(t):
    return FS.pack_files(t.files, "web").groupBy("repo").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query
def path_parts(t):
    return PA.path_parts(t.web.unionByName(t.files))


@query
def language_of(t):
    return CL.with_language(t.files.select("repo", "path", "ext")).groupBy("repo", "language").agg(F.count("*").alias("n"))


@query
def role_of(t):
    both = t.files.select("repo", "ext").unionByName(t.web.select("repo", "ext"))
    return both.groupBy("repo", CL.role_column(F.col("ext")).alias("role")).agg(F.count("*").alias("n"))


@query
def entry_points(t):
    name = PA.basename(F.col("path"))
    return t.files.filter(CL.entry_point_column(name)).select("repo", "path")


@query
def build_files(t):
    return t.files.filter(CL.build_file_column(PA.basename(F.col("path")))).select("repo", "path")


@query
def describe_ext(t):
    return CL.describe_ext(t.files)


@query
def language_names(t):
    rows = [tuple(r) for r in corpus.inferred_seed(t.spark, t.sf).collect()]  # two rows
    return RG.list_languages(t.spark, REGISTRY.with_inferred(rows))


@query
def inferred_tier(t):
    rows = [tuple(r) for r in corpus.inferred_seed(t.spark, t.sf).collect()]  # two rows
    out = CL.with_language(t.files.select("repo", "path", "ext"), REGISTRY.with_inferred(rows))
    return out.groupBy("ext", "language").agg(F.count("*").alias("n"))


@query
def classify_files(t):
    return CL.classify_files(t.files).select("repo", "path", "category", "confidence")


@query
def category_counts(t):
    return CL.category_counts(CL.classify_files(t.files.unionByName(t.web)))


@query
def structural_role(t):
    return CL.structural_role(t.files.unionByName(t.web))


@query
def negative_paths(t):
    return t.files.filter(CL.negative_path(F.col("path"))).select("repo", "path")


@query
def business_paths(t):
    return t.files.unionByName(t.web).groupBy("repo").agg(
        F.count_if(CL.business_path(F.col("path"))).alias("business"), F.count("*").alias("n"))


@query
def role_files(t):
    return CL.role_files(t.files)


@query
def role_buckets(t):
    return CL.role_buckets(t.files.unionByName(t.web))


@query
def directory_rollup(t):
    return CL.directory_rollup(t.files.unionByName(t.web))


@query
def scan_with_category(t):
    part = CL.classify_files(t.files.filter(F.col("ext") != ".md"))
    return CL.join_classified(t.files, part)


@query
def final_payload(t):
    ex = A.extract(t.files)
    return ex["payload"]


@query
def payload_files(t):
    """The record of every file."""
    return MO.payload_files(t.scan, t.classified)


@query
def payload_records(t):
    """The same as JSON lines, as a writer stores them."""
    return MO.payload_json(MO.payload_files(t.scan, t.classified))


# ---- chunks and pieces --------------------------------------------------------------------------

@query
def chunk_lines(t):
    return t.chunks.select("repo", "path", "category", "chunk_no", "chunk_id", F.length("content").alias("chars"))


@query
def snippet_of(t):
    return C.snippet_of(t.files).select("repo", "path", "ext", F.md5("snippet").alias("digest"))


@query
def key_snippets(t):
    return C.key_snippets(t.chunks)


@query
def model_candidate_files(t):
    return C.model_candidate_files(t.files)


@query
def keyword_features(t):
    return C.keyword_features(t.files)


@query
def keyword_files(t):
    return C.keyword_files(t.files)


@query
def coarse_modules(t):
    out = C.coarse_modules(CL.role_files(t.files))
    return out.select("repo", F.array_join("modules", ",").alias("modules"))


@query
def doc_gaps(t):
    return C.doc_gaps(t.files, CL.role_files(t.files)).select("repo", F.array_join("gaps", ";").alias("gaps"))


@query
def modules(t):
    return MO.modules(t.chunks)


@query
def module_files(t):
    return t.members


@query
def normalize_modules(t):
    return t.modules


@query
def validate_modules(t):
    return t.validation


@query
def validate_web_modules(t):
    mods = MO.normalize_modules(t.web.select("repo", PA.top_dir(F.col("path")).alias("module"), "path"))
    return MO.validate_modules(mods, t.web)


@query
def validation_issues(t):
    mods = MO.normalize_modules(t.web.select("repo", PA.top_dir(F.col("path")).alias("module"), "path"))
    return MO.validation_issues(mods, t.web)


# ---- signals ---------------------------------------------------------------------------------------

@query
def notebook_code(t):
    return S.notebook_code(t.files.filter("ext = '.ipynb'")).select("repo", "path", "content")


@query
def presence_signals(t):
    return S.presence_signals(t.files)


@query
def apply_rules(t):
    rules = [SR.Rule("user", "import", r"(?m)^(?:import|from) \w+", (".py",)), SR.Rule("user", "html", r"(?i)<html"),
             SR.Rule("user", "digits", r"\d{4}"), SR.Rule("user", "question", r"\?")]
    return S.signal_counts(S.apply_rules(t.files, rules))


@query
def scan_defects(t):
    return S.scan_defects(t.files).select("repo", "path", "line", "type", "severity", "description")


@query
def sort_defects(t):
    return S.sort_defects(S.scan_defects(t.files)).select("repo", "defect_id", "type", "path", "line")


@query
def http_contracts(t):
    return S.http_contracts(t.files).select("repo", "method", "path", "source_file")


@query
def auth_signals(t):
    return S.auth_signals(t.files)


@query
def middleware_signals(t):
    return S.middleware_signals(t.files)


@query
def pipeline_definitions(t):
    return S.pipeline_definitions(t.files)


@query
def orchestrators(t):
    return S.orchestrators(t.files)


@query
def data_sources(t):
    return S.data_sources(t.files)


@query
def data_quality_checks(t):
    return S.data_quality_checks(t.files)


@query
def ml_stages(t):
    return S.ml_stages(t.files)


@query
def model_types(t):
    return S.model_types(t.files)


@query
def ml_frameworks(t):
    return S.ml_frameworks(t.files)


@query
def eval_metrics(t):
    return S.eval_metrics(t.files)


@query
def app_screens(t):
    return S.app_screens(t.files)


@query
def device_permissions(t):
    return S.device_permissions(t.files)


@query
def mobile_platforms(t):
    return S.mobile_platforms(t.files)


@query
def desktop_ui_signals(t):
    return S.desktop_ui_signals(t.files)


@query
def react_docker_signals(t):
    return S.react_docker_signals(t.files)


@query
def compliance_mentions(t):
    return E.compliance_mentions(t.files)


@query
def k8s_manifests(t):
    return E.k8s_manifests(t.files)


# ---- code and manifests ------------------------------------------------------------------------------

@query
def spring_endpoints(t):
    return CO.spring_endpoints(t.files).drop("kind")


@query
def proto_rpcs(t):
    return CO.proto_rpcs(t.files).drop("pos")


def _flat(df):
    return df.select("repo", "name", "source_file", "table_name", F.array_join("fields", ",").alias("fields"), "entity_type")


@query
def jpa_entities(t):
    return _flat(CO.jpa_entities(t.files))


@query
def kotlin_data_classes(t):
    return _flat(CO.kotlin_data_classes(t.files))


@query
def proto_messages(t):
    return _flat(CO.proto_messages(t.files))


@query
def entities(t):
    return _flat(CO.entities(t.files))


def _deps(df):
    return df.select("repo", "tool", "manifest", "name", "version", "category", "pos")


@query
def gradle_deps(t):
    return _deps(M.gradle_deps(t.files))


@query
def maven_deps(t):
    return _deps(M.maven_deps(t.files))


@query
def npm_deps(t):
    return _deps(M.npm_deps(t.files))


@query
def pip_deps(t):
    return _deps(M.pip_deps(t.files))


@query
def declared_dependencies(t):
    return _deps(M.declared_dependencies(t.files))


@query
def dependencies(t):
    return t.deps.drop("seq")


@query
def build_facts(t):
    return M.build_facts(t.files)


@query
def dep_buckets(t):
    return M.dep_buckets(t.deps)


@query
def package_metadata(t):
    return M.package_metadata(t.files)


@query
def intent_waterfall(t):
    return M.intent_waterfall(t.files)


# ---- evidence ---------------------------------------------------------------------------------------------

@query
def evidence(t):
    return t.evidence


@query
def infra_files(t):
    return E.infra_files(t.files)


@query
def evidence_flags(t):
    return E.unpivot_flags(t.evidence)


@query
def stack_labels(t):
    return t.labels


@query
def path_globs(t):
    globs = ["**/*.proto", "**/controllers/**", "docs/*", "**/test_*", "src/**/*.{js,ts}", "**/models/**/*.sql"]
    return E.paths_matching(t.files, globs)


@query
def pack_score(t):
    return E.pack_score(t.files, t.deps, t.evidence, all_scores=True)


@query
def active_packs(t):
    return E.pack_score(t.files, t.deps, t.evidence)


@query
def evidence_fingerprint(t):
    return E.evidence_fingerprint(t.evidence)


# ---- features ----------------------------------------------------------------------------------------------

@query
def fallback_features(t):
    return t.fallback.select("repo", "feature_id", "name", "description", "source")


@query
def feature_file_counts(t):
    return FT.feature_file_counts(t.fallback, t.classified)


@query
def calibrate_confidence(t):
    return FT.calibrate_confidence(t.fallback, FT.feature_sources(t.fallback), t.classified).select("repo", "feature_id", "name", "conf", "n_files")


@query
def dedupe_features(t):
    return FT.dedupe_features(t.seed).select("repo", "name", "description", "conf", "members")


@query
def merge_features(t):
    return FT.merge_features(t.seed).select("repo", "name", "description", "conf", "members")


@query
def validate_features(t):
    return t.features.select("repo", "feature_id", "name", "description", "conf", "members")


@query
def merge_members(t):
    return FT.merge_members(t.seed, t.features)


@query
def merge_skill_features(t):
    extra = t.pack_feats.withColumn("ord", F.struct("pack", "family", "name"))
    out = FT.merge_skill_features(t.fallback, extra)
    return out.groupBy("repo").agg(F.count("*").alias("n"), F.max("feature_id").alias("last_id"), F.sum("conf").alias("conf"))


@query
def prune_features(t):
    ids = t.features.filter("conf >= 50").select("repo", "feature_id")
    return FT.prune_features(t.features, ids).select("repo", "feature_id", "name")


def _signals(t):
    """Rule signals as interpretation input: one signal per (repo, family, signal)."""
    found = S.presence_signals(t.scan, ["middleware", "orchestrator", "stage"])
    sid = F.concat("family", F.lit("."), "signal")
    signals = found.groupBy("repo", "family", "signal").agg(F.count("*").alias("n")).select(
        "repo", sid.alias("signal_id"), F.col("signal").alias("name"),
        F.concat(F.lit("Uses "), "family", F.lit(" "), "signal", F.lit(" in python code")).alias("description"),
        F.least(F.lit(95), 35 + 7 * F.col("n")).cast("int").alias("conf"))
    rows = found.select("repo", sid.alias("signal_id"), "path")
    return signals, rows.filter(~F.col("signal_id").startswith("orchestrator"))


@query
def signal_modules(t):
    signals, rows = _signals(t)
    return FT.signal_modules(signals, rows, MO.normal_module_files(t.members))


def _interpreted(t):
    signals, rows = _signals(t)
    pool = t.repos.select("repo", F.explode(TX.lit_array(["Python", "cors", "zz top"])).alias("item"))
    return hold(signals), hold(rows), MO.normal_module_files(t.members), pool


@query
def interpret_features(t):
    return FT.interpret_features(*_interpreted(t))


@query
def interpretation_evidence(t):
    return FT.interpretation_evidence(*_interpreted(t))


@query
def archetype_votes(t):
    return FT.archetype_votes(t.features)


@query
def archetype_vote(t):
    return FT.archetype_vote(t.features)


@query
def capabilities(t):
    return FT.capabilities(t.features)


@query
def product_summary(t):
    return FT.product_summary(t.features)


@query
def business_context(t):
    return FT.business_context(t.features, "web")


@query
def signal_features(t):
    return t.pack_feats


@query
def pack_results(t):
    scores = E.pack_score(t.files, t.deps, t.evidence)
    return FT.merge_pack_results(scores, t.pack_feats, _pack_signals(t))[0]


def _pack_signals(t):
    packs = F.create_map(*[F.lit(x) for f, p in {"middleware": "web_api", "orchestrator": "data_platform", "quality": "data_platform",
                                                 "metric": "ml_pipeline", "framework": "ml_pipeline"}.items() for x in (f, p)])
    rows = S.signal_counts(S.presence_signals(t.scan, ["middleware", "orchestrator", "quality", "metric", "framework"]))
    return rows.select("repo", F.element_at(packs, F.col("family")).alias("pack"), "family", "signal")


@query
def pack_signals(t):
    scores = E.pack_score(t.files, t.deps, t.evidence)
    return FT.merge_pack_results(scores, t.pack_feats, _pack_signals(t))[1]


@query
def pack_hints(t):
    scores = E.pack_score(t.files, t.deps, t.evidence)
    return FT.merge_pack_results(scores, t.pack_feats, _pack_signals(t))[2]


# ---- requirements ------------------------------------------------------------------------------------------

@query
def functional_requirements(t):
    return t.frs.select("repo", "req_id", "linked_feature", "description", F.array_join("acceptance", " ").alias("acceptance"))


@query
def nonfunctional_requirements(t):
    return RQ.nonfunctional_requirements(t.labels, t.repos)


@query
def feature_category(t):
    rows = t.files.select("repo", PA.top_dir(F.col("path")).alias("module"), F.col("path").alias("ord"), F.col("path").alias("source"))
    return RQ.feature_category(rows, ["repo", "module"])


@query
def payload_features(t):
    return t.payload.select("repo", "feature_id", "name", "conf", "n_files", "category")


@query
def payload_requirements(t):
    return RQ.payload_requirements(t.payload)


@query
def requirement_modules(t):
    return RQ.requirement_modules(t.members, t.payload)


@query
def system_summary(t):
    return RQ.system_summary(t.modules, t.repos)


@query
def requirement_priorities(t):
    cat = F.element_at(F.create_map(*[F.lit(x) for p in enumerate(["core_pipeline", "feature_detection", "unknown", "api"]) for x in p]), (F.col("ord") % 4).cast("int"))
    weak = (F.col("conf") - 30).cast("int")
    return t.seed.select("repo", "feature_id", RQ.requirement_priority(cat, weak).alias("priority"), FT.moscow(F.col("conf")).alias("moscow"))


@query
def glossary(t):
    words = t.classified.select("repo", F.col("category").alias("term"), F.concat(F.lit("seen in "), "path").alias("definition"), F.col("path").alias("ord"))
    return RQ.glossary(words)


@query
def requirement_confidence(t):
    part = t.features.filter("ord % 2 = 1")
    return RQ.requirement_confidence(t.frs, part).select("repo", "req_id", "conf", "feature_text")


@query
def requirement_table(t):
    return RQ.requirement_table(t.features, t.frs).drop("ord", "feature_ord")


@query
def enriched_requirements(t):
    notes = t.frs.filter("ord % 3 = 0").select("repo", "req_id", F.concat(F.lit("Plain "), "req_id").alias("plain"),
                                               F.lit(None).cast("string").alias("technical"), F.lit("High impact").alias("impact"), F.lit(None).cast("string").alias("acceptance"))
    return RQ.requirement_table(t.features, t.frs, notes).drop("ord", "feature_ord")


@query
def requirement_batches(t):
    return RQ.requirement_batches(t.frs)


# ---- documents -------------------------------------------------------------------------------------------------

@query
def requirement_ids(t):
    return Q.requirement_ids(t.docs)


@query
def split_sections(t):
    return Q.split_sections(t.docs)


@query
def phantom_ids(t):
    return Q.phantom_ids(t.docs, t.frs)


@query
def missing_references(t):
    return Q.missing_references(t.docs, t.features, t.frs)


@query
def claims(t):
    return Q.claims(t.docs, t.evidence)


@query
def text_scores(t):
    return Q.text_scores(t.docs).drop("mentioned")


@query
def score_traceability(t):
    return Q.score_traceability(t.docs, t.features, t.frs)


@query
def score_phantom_ids(t):
    return Q.score_phantom_ids(t.docs, t.frs)


@query
def score_grounding(t):
    return Q.grounding_scores(Q.text_scores(t.docs), t.evidence).select("doc_key", "grounding", "n_ungrounded")


@query
def score_document(t):
    return Q.score_document(t.docs, t.features, t.frs, t.evidence)


@query
def document_issues(t):
    return Q.document_issues(t.docs, t.features, t.frs, t.evidence)


@query
def repair_clarity(t):
    return RP.repair_clarity(t.docs).select("doc_key", "n_replaced", F.md5("text").alias("digest"))


@query
def repair_grounding(t):
    return RP.repair_grounding(t.docs, t.evidence).select("doc_key", F.md5("text").alias("digest"))


@query
def repair_structure(t):
    return RP.repair_structure(t.docs).select("doc_key", F.md5("text").alias("digest"))


@query
def revision_log(t):
    """Every replacement of a repair pass over the documents."""
    return RP.revision_log(t.docs, t.evidence)


@query
def replayed_documents(t):
    """Texts made from the log equal those of the repair; only their digests are returned."""
    return RP.replay(t.docs, hold(RP.revision_log(t.docs, t.evidence))).select("doc_key", F.md5("text").alias("digest"))


@query
def traceability_appendix(t):
    return RP.traceability_appendix(t.docs, t.features, t.frs)


@query
def repair_loop(t):
    return RP.repair_loop(t.docs, t.features, t.frs, hold(t.evidence)).select("doc_key", "iterations", "first_score", "score", "needs_revision")


# ---- reports -----------------------------------------------------------------------------------------------------

@query
def layer_inventory(t):
    return R.layer_inventory(t.features).drop("ord")


@query
def interface_table(t):
    return R.interface_table(t.evidence, CO.spring_endpoints(t.slim), CO.proto_rpcs(t.slim))


@query
def data_rows(t):
    return R.data_rows(t.evidence, t.deps)


@query
def tech_purpose(t):
    sub, tok = R.tech_purpose(t.labels), R.tech_purpose(t.labels, "token")
    return sub.withColumn("mode", F.lit("substring")).unionByName(tok.withColumn("mode", F.lit("token")))


@query
def stack_table(t):
    return R.stack_table(t.labels)


@query
def infra_rows(t):
    return R.infra_rows(t.evidence, t.labels)


@query
def risk_register(t):
    return R.risk_register(t.features, t.repos).drop("ord")


@query
def compliance_rows(t):
    return R.compliance_rows(t.evidence)


@query
def open_issues(t):
    return R.open_issues(t.features, t.labels, t.repos).drop("ord")


@query
def stakeholder_rows(t):
    return R.stakeholder_rows(FT.business_context(t.features, "web"))


@query
def scope_and_goals(t):
    return R.scope_and_goals(t.features)


@query
def executive_rows(t):
    return R.executive_rows(t.features, FT.business_context(t.features, "web"))


@query
def review_items(t):
    return R.review_items(t.features)


@query
def render_report(t):
    ev = hold(t.evidence)
    found = {"evidence": ev, "labels": E.stack_labels(t.deps, ev), "deps": t.deps, "endpoints": CO.spring_endpoints(t.slim), "rpcs": CO.proto_rpcs(t.slim)}
    lines = R.report_lines(A.report_tables(t.features, found, t.repos), DATE)
    return R.render_report(lines)


# ---- learning and numbering ----------------------------------------------------------------------------------------

@query
def representative_per_ext(t):
    return L.representative_per_ext(CL.classify_files(t.files)).select("repo", "ext", "path")


@query
def unknown_extensions(t):
    return L.unknown_extensions(CL.classify_files(t.files), RG.lang_ext(t.spark)).select("repo", "ext", "path", F.md5("snippet").alias("digest"))


@query
def infer_languages(t):
    return L.infer_languages(L.unknown_extensions(CL.classify_files(t.files), RG.lang_ext(t.spark)))


@query
def learned_languages(t):
    cache = corpus.inferred_seed(t.spark, t.sf).filter("ext = '.py'").withColumn("confidence", F.lit(0.9))
    scored = L.infer_languages(L.snippet_of(L.representative_per_ext(CL.classify_files(t.files))))
    return L.upsert_inferences(cache, L.accept_inferences(scored))


@query
def text_functions(t):
    """Every text helper over real names and texts."""
    name, text = F.col("path"), F.col("content")
    snake = TX.snake(name)
    return t.files.select(
        "repo", "path", snake.alias("snake"), TX.module_snake(name).alias("module_snake"), TX.display(snake).alias("display"),
        TX.humanize(snake).alias("humanize"), TX.title_with_acronyms(snake).alias("acronyms"), TX.word_count(text).alias("words"),
        F.md5(TX.trim_to_words(text, 120)).alias("trimmed"), TX.clean_dep_name(F.concat(F.lit(" \"'"), name, F.lit("' "))).alias("clean"),
        F.md5(TX.top_docstring(text)).alias("docstring"), TX.uuid5(name).alias("uuid"), TX.md5_fingerprint(text).alias("fingerprint"),
        TX.percent(F.col("size") % 100 / 100).alias("percent"))


@query
def first_per_key(t):
    return N.first_per_key(t.files.select("repo", "ext", "path"), ["repo", "ext"], ["path"])


@query
def top_k_per_group(t):
    return N.top_k(t.files.select("repo", "path", "size"), ["repo"], [F.desc("size"), "path"], 5)


@query
def number_rows(t):
    return N.with_ids(t.files.select("repo", "path"), ["repo"], ["path"], "ITEM-", 3, hot_rows=20).drop("n")


@query
def batches(t):
    return N.batches(t.files.select("repo", "path"), ["repo"], ["path"], 8).drop("n")
