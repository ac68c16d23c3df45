"""Signal rules over file contents: one pass evaluates every family.

``tagged`` scans the contents once for all families (``matcher``) and leaves the matches of every
file; each operator below reads its own family from them, of a held scan as well as of files. Rules
of users (``apply_rules``) are literal ``rlike`` conditions inside one array expression. Names and
files are rows, never arrays that grow with the repository.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import basename, in_dirs, stem
from ..functions.text import lit_array, occurs, sql_text
from ..rules import signals as S
from ..sources.files import pack_filter
from .matcher import Search, hits_of, tagged_matches
from .numbering import top_k, with_ids

NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"


def notebook_text(content: Column) -> Column:
    cells = F.from_json(content, NOTEBOOK)["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    return F.array_join(F.transform(code, lambda c: F.array_join(c["source"], "\n")), "\n")


def notebook_code(df: DataFrame) -> DataFrame:
    """Notebooks keep the text of their code cells only; broken ones are dropped."""
    is_nb = F.col("ext") == ".ipynb"
    return df.withColumn("content", F.when(is_nb, notebook_text(F.col("content"))).otherwise(F.col("content"))) \
             .filter(F.col("content").isNotNull())


def _hits(rules, guard) -> Column:
    """Array of (family, signal) of the rules that hit; ``guard`` gives a rule's file condition."""
    sqls = [f"case when {guard(r)} and {occurs(r.regex)} then named_struct('family', {sql_text(r.family)}, "
            f"'signal', {sql_text(r.signal)}) end" for r in rules]
    return F.array_distinct(F.array_compact(F.array(*[F.expr(x) for x in sqls])))


def apply_rules(df: DataFrame, rules) -> DataFrame:
    """K1: (repo, path, family, signal) for every rule whose regex occurs in the file.

    ``rules`` are built-in or user-made ``Rule`` rows; a file yields a signal at most once.
    """
    guard = lambda r: f"ext in ({', '.join(sql_text(e) for e in r.exts)})" if r.exts else "true"
    rows = df.select("repo", "path", "ext", "content", F.lower("content").alias("lowered"))
    return rows.select("repo", "path", F.explode(_hits(rules, guard)).alias("hit")).select("repo", "path", "hit.family", "hit.signal")


def searches(families=None) -> list[Search]:
    """The searches of the built-in families, each behind its pack's files."""
    out = [Search(r.family, r.signal, r.regex, f"in_{S.FAMILY_PACK[r.family]}") for r in S.presence_rules()]
    out += [Search("route", kind, rx, "in_web", (), 2) for kind, rx in S.ROUTE_REGEXES]
    out.append(Search("rpc", "gRPC", S.GRPC_NAME, "in_web", (), 1))
    out += [Search("auth_count", kind, rx, "in_web", (), -1) for kind, rx in S.AUTH_RULES]
    out += [Search("pipeline", "airflow_dag", S.AIRFLOW_DAG, "in_data", (), 1), Search("pipeline", "dbt_model", S.DBT_REF, "in_data"),
            Search("pipeline", "dbt_model", S.DBT_SOURCE, "in_data"), Search("pipeline", "dagster_asset", S.DAGSTER, "in_data"),
            Search("pipeline", "prefect_flow", S.PREFECT, "in_data"), Search("pipeline", "luigi_task", S.LUIGI, "in_data", (), 1)]
    out += [Search("screen", kind, rx, "in_mobile", exts, 1) for kind, rx, exts in S.SCREEN_RULES]
    out += [Search("permission", "android", S.ANDROID_PERMISSION, "in_mobile", (), 1), Search("permission", "ios", S.IOS_PERMISSION, "in_mobile", (), 1)]
    return [s for s in out if families is None or s.family in families]


def tagged(df: DataFrame, families=None) -> DataFrame:
    """(repo, path, ext, hits) of the files in which some family finds something: the one scan of E20."""
    if "hits" in df.columns:
        return df
    wanted = searches(families)
    packs = sorted({s.where[3:] for s in wanted})
    kept = df.filter(reduce(lambda a, b: a | b, [pack_filter(p) for p in packs]))
    if "ml" in packs:
        kept = notebook_code(kept)
    return tagged_matches(kept.select("repo", "path", "ext", "content", *[pack_filter(p).alias(f"in_{p}") for p in packs]), wanted)


def presence_signals(df: DataFrame, families=None) -> DataFrame:
    """(repo, path, family, signal): the families that ask whether a file mentions something; a file yields a signal once."""
    families = [f for f in S.FAMILY_PACK if families is None or f in families]
    named = F.transform(F.filter("hits", lambda h: h["family"].isin(families)), lambda h: F.struct(h["family"].alias("family"), h["signal"].alias("signal")))
    return tagged(df, families).select("repo", "path", F.explode(F.array_distinct(named)).alias("h")).select("repo", "path", "h.*")


def signal_counts(signals: DataFrame) -> DataFrame:
    """Files per (repo, family, signal)."""
    return signals.groupBy("repo", "family", "signal").agg(F.count("*").alias("n_files"))


def middleware_signals(df):
    """C16"""
    return signal_counts(presence_signals(df, ["middleware"])).drop("family")


def orchestrators(df):
    """C18"""
    return signal_counts(presence_signals(df, ["orchestrator"])).drop("family")


def data_sources(df):
    """C19"""
    return signal_counts(presence_signals(df, ["source"])).drop("family")


def data_quality_checks(df):
    """C20"""
    return signal_counts(presence_signals(df, ["quality"])).drop("family")


def ml_stages(df):
    """Stage, number of files and confidence min(0.9, 0.6 + 0.1 per file)."""
    out = signal_counts(presence_signals(df, ["stage"])).drop("family")
    return out.withColumn("confidence", F.least(F.lit(90), 60 + 10 * F.col("n_files")) / 100)


def model_types(df):
    """Architectures with confidence min(0.9, 0.7 + 0.05 per file)."""
    out = signal_counts(presence_signals(df, ["model"])).drop("family")
    return out.withColumn("confidence", F.least(F.lit(90), 70 + 5 * F.col("n_files")) / 100)


def ml_frameworks(df):
    """C22"""
    return signal_counts(presence_signals(df, ["framework"])).drop("family")


def eval_metrics(df, files: int = 3):
    """Every metric with its first ``files`` files."""
    rows = presence_signals(df, ["metric"]).drop("family")
    return top_k(rows, ["repo", "signal"], ["path"], files)


def auth_hits(df: DataFrame, most: int = 3) -> DataFrame:
    """Hits per file and auth type; one regex counts at most ``most`` times in a file."""
    types = list(dict.fromkeys(t for t, _ in S.AUTH_RULES))
    order = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(types) for x in (t, i)]), F.col("auth_type"))
    rows = hits_of(tagged(df, ["auth_count"]), "auth_count").select("repo", "path", F.col("signal").alias("auth_type"), F.least("n", F.lit(most)).alias("n"))
    return rows.groupBy("repo", "path", "auth_type").agg(F.sum("n").alias("hits")).select("repo", "path", "auth_type", order.alias("ord"), "hits")


def auth_signals(df: DataFrame) -> DataFrame:
    """Hits per auth type; the dominant one leads, the others need two hits to be secondary.

    A tie goes to the type seen first: earliest file, then rule order.
    """
    per_type = auth_hits(df).groupBy("repo", "auth_type").agg(
        F.sum("hits").alias("hits"), F.count("*").alias("n_files"), F.min(F.struct("path", "ord")).alias("seen"))
    best = per_type.groupBy("repo").agg(F.min(F.struct((-F.col("hits")).alias("h"), "seen", "auth_type"))["auth_type"].alias("dominant"))
    rank = (F.when(F.col("auth_type") == F.col("dominant"), "dominant").when(F.col("hits") >= 2, "secondary").otherwise("weak"))
    return per_type.join(best, "repo").select("repo", "auth_type", "hits", "n_files", rank.alias("standing"))


def matches(content: Column, regex: str, groups, fields) -> Column:
    """Array of structs with one field per group of every match of ``regex``."""
    cols = [F.regexp_extract_all(content, F.lit(regex), F.lit(g)) for g in groups]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(cols, fields)])
    return F.transform(zipped, lambda z: F.struct(*[z[n].alias(n) for n in fields]))


def http_contracts(df: DataFrame) -> DataFrame:
    """C14: distinct (method, path) of routes and gRPC names, with the first file that has them."""
    rows = hits_of(tagged(df, ["route", "rpc"]), "route", "rpc").withColumnRenamed("path", "source_file")
    is_rpc = F.col("family") == "rpc"
    rows = rows.filter(is_rpc | ~F.regexp_replace("two", "/+$", "").isin(S.BOILERPLATE_PATHS)).select(
        "repo", "source_file", "at", is_rpc.cast("int").alias("kind"), F.when(is_rpc, F.col("signal")).otherwise(F.upper("one")).alias("method"),
        F.when(is_rpc, F.col("one")).otherwise(F.col("two")).alias("path"))
    return rows.groupBy("repo", "method", "path").agg(
        F.min(F.struct("kind", "source_file", "at")).alias("first")).select(
            "repo", "method", "path", F.col("first.source_file").alias("source_file"), F.col("first.kind").alias("kind"),
            F.col("first.at").alias("pos"))


def pipeline_definitions(df: DataFrame) -> DataFrame:
    """C17: distinct (name, type) of pipeline definitions with the first file that has them.

    Models, assets and flows go by the name of their file.
    """
    rows = hits_of(tagged(df, ["pipeline"]), "pipeline")
    return rows.groupBy("repo", F.coalesce("one", stem(F.col("path"))).alias("name"), F.col("signal").alias("type")).agg(F.min("path").alias("source_file"))


def app_screens(df: DataFrame) -> DataFrame:
    """Distinct (name, type) of screens with the first file that has them."""
    return hits_of(tagged(df, ["screen"]), "screen").groupBy("repo", F.col("one").alias("name"), F.col("signal").alias("type")).agg(F.min("path").alias("source_file"))


def device_permissions(df: DataFrame) -> DataFrame:
    """Distinct declared permissions per repository and platform."""
    return hits_of(tagged(df, ["permission"]), "permission").select("repo", F.col("signal").alias("platform"), F.col("one").alias("permission")).distinct()


def mobile_platforms(df: DataFrame) -> DataFrame:
    """Platforms by marker files; looks at paths only."""
    name, path = basename(F.col("path")), F.col("path")
    # a project bundle is a directory in a checkout, so its name may stand anywhere in the path
    bundle = path.rlike(r"(\.xcodeproj|\.xcworkspace)(/|$)")
    marks = F.array_compact(F.array(
        F.when((name == "AndroidManifest.xml") | name.startswith("build.gradle"), "android"),
        F.when(bundle | (name == "Podfile"), "ios"),
        F.when(path == "pubspec.yaml", "flutter"),
        F.when(path.isin("app.json", "metro.config.js"), "react_native")))
    return df.select("repo", F.explode(marks).alias("platform")).distinct()


def desktop_ui_signals(df: DataFrame) -> DataFrame:
    """(repo, path, kind, line, text) of README mentions, ribbon files, UI sources, Clicked lines."""
    name = F.lower(basename(F.col("path")))
    content = F.col("content")
    readme = name.startswith("readme") | name.endswith(".md")
    none, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    flag = lambda cond, kind: F.when(cond, F.struct(F.lit(kind).alias("kind"), none.alias("line"), no_text.alias("text")))
    flags = F.array_compact(F.array(
        flag(readme & content.rlike("(?i)powerbuilder|appeon"), "readme"),
        flag(name.endswith(".xml") & (name.contains("ribbon") | content.rlike("(?i)ribbon")), "ribbon_xml"),
        flag(name.rlike("(" + "|".join(e.replace(".", r"\.") for e in S.PB_SOURCE_EXTS) + ")$")
             | content.rlike(r"(?i)\bPowerBuilder\b|appeon"), "ui_source")))
    lines = F.transform(F.split(content, r"\R"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    clicked = F.when(content.rlike("(?i)Clicked"), F.transform(
        F.filter(lines, lambda s: s["text"].rlike("(?i)Clicked")),
        lambda s: F.struct(F.lit("clicked").alias("kind"), s["line"].alias("line"), F.trim(s["text"]).alias("text"))))
    clicked = F.coalesce(clicked, F.expr("cast(array() as array<struct<kind:string,line:int,text:string>>)"))
    return df.select("repo", "path", F.explode(F.concat(flags, clicked)).alias("e")).select("repo", "path", "e.*")


def react_docker_signals(df: DataFrame) -> DataFrame:
    """One row per repository: Docker, manifest and React file counts, library flags, confidence."""
    name, content, ext = F.lower(basename(F.col("path"))), F.col("content"), F.col("ext")
    js = ext.isin(*S.RN_EXTS)
    manifest = name == "package.json"
    maps = F.from_json("content", "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>")
    keys = F.concat(*[F.coalesce(F.map_keys(maps[k]), F.expr("cast(array() as array<string>)"))
                      for k in ("dependencies", "devDependencies", "peerDependencies")])
    names = F.when(manifest, F.lower(F.array_join(F.array_distinct(keys), " ")))
    uses = lambda word: (js & content.contains(word)) | F.coalesce(names.contains(word), F.lit(False))
    tailwind = uses("tailwind") | (js & content.contains("className") & content.contains("tw-"))
    react = js & (content.rlike(r"""\bReact\b|from\s+['"]react['"]""") | basename(F.col("path")).rlike(r"\.tsx?\b"))
    docker = name.startswith("dockerfile") | F.array_contains(F.split("path", "/"), "docker")
    has_deps = manifest & (F.coalesce(F.length(names), F.lit(0)) > 0)
    out = df.groupBy("repo").agg(
        F.count_if(docker).alias("dockerfiles"), F.count_if(manifest).alias("manifests"),
        F.count_if(name.startswith("readme")).alias("readmes"), F.count_if(react).alias("react_files"),
        F.bool_or(uses("pdfjs")).alias("uses_pdfjs"), F.bool_or(uses("react-dropzone")).alias("uses_dropzone"),
        F.bool_or(uses("react-router")).alias("uses_router"), F.bool_or(tailwind).alias("uses_tailwind"),
        F.bool_or(has_deps).alias("has_deps"))
    points = (F.when(F.col("dockerfiles") > 0, 40).otherwise(0) + F.when(F.col("react_files") > 0, 40).otherwise(0)
              + F.when(F.col("has_deps"), 20).otherwise(0))
    return out.withColumn("confidence", points / 100).drop("has_deps")


def scan_defects(df: DataFrame) -> DataFrame:
    """(repo, path, line, type, severity, description, rule) of every defect line.

    A file is split into lines only when some rule occurs in it, and stays one row until the
    hits are known.
    """
    path, name = F.col("path"), F.lower(basename(F.col("path")))
    is_test = F.lower(path).contains("/test/") | F.lower(stem(path)).contains("test")
    anywhere = F.expr(" or ".join(occurs(rx) for rx, *_ in S.DEFECT_RULES))
    kept = df.withColumn("lowered", F.lower("content")).filter((F.col("ext").isin(S.DEFECT_EXTS) | name.isin(S.DEFECT_NAMES))
                     & ~F.arrays_overlap(F.split("path", "/"), lit_array(S.DEFECT_SKIP_DIRS))).filter(anywhere)
    lines = kept.select("repo", "path", is_test.alias("is_test"),
                        F.posexplode(F.split("content", r"\R")).alias("pos", "text"))

    def hit(i, regex, kind, severity, message):
        text = F.lit(message)
        if "{detail}" in message:
            detail = F.trim(F.regexp_extract("text", regex, 1))
            text = F.concat(F.lit(message.replace("{detail}", "")), detail)
        cond = F.col("text").rlike(regex)
        if kind == "blocking_call":
            cond = cond & ~F.col("is_test")
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                                     text.alias("description"), F.lit(i).alias("rule")))

    hits = F.array_compact(F.array(*[hit(i, *rule) for i, rule in enumerate(S.DEFECT_RULES)]))
    return lines.select("repo", "path", (F.col("pos") + 1).alias("line"), F.explode(hits).alias("h")) \
                .select("repo", "path", "line", "h.*")


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for i, name in reversed(list(enumerate(S.SEVERITY_ORDER))):
        out = F.when(severity == name, i).otherwise(out)
    return out


def sort_defects(defects: DataFrame) -> DataFrame:
    """defects numbered BUG-01, BUG-02 ... by severity, file, line and rule."""
    ranked = defects.withColumn("sev", severity_rank(F.col("severity")))
    return with_ids(ranked, ["repo"], ["sev", "path", "line", "rule"], "BUG-", 2, "defect_id").drop("sev", "n")
