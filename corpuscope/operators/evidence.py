"""The evidence record of a repository, technology labels and pack scores."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import basename, dirs
from ..functions.text import contains_any, glob_regex, lit_array, md5_fingerprint, title
from ..rules import packs as P, signals as S
from .manifests import MANIFESTS, dep_bucket
from .numbering import top_k

FLAGS = ["has_http_api", "has_grpc", "has_database", "has_auth", "has_docker", "has_kubernetes",
         "has_android", "has_ios", "has_desktop", "has_gdpr_mention", "has_tests"]


def _has_dir(names):
    return F.arrays_overlap(dirs(F.lower("path")), lit_array(names))


def relevant_contents(scan: DataFrame) -> DataFrame:
    """All files, but with the content only where an evidence operator can use it.

    Held once, this table serves endpoints, RPCs, dependencies, flags and compliance without
    reading the corpus again for each.
    """
    name, ext, content = basename(F.col("path")), F.col("ext"), F.col("content")
    doc = name.endswith(".md") | name.rlike("^(README|readme|PRIVACY|privacy)")
    build = name.isin([n for _, names, _ in MANIFESTS for n in names])
    needed = (build | (ext == ".proto") | (ext.isin(".kt", ".java") & content.contains("Controller"))
              | (ext.isin(".yaml", ".yml") & k8s_manifest(content)) | (doc & content.rlike(S.COMPLIANCE)))
    return scan.select("repo", "path", "ext", "size", F.when(needed, content).alias("content"))


def k8s_manifest(content):
    """A Kubernetes kind at the start of a line."""
    return content.rlike(S.K8S_KIND)


def k8s_manifests(df: DataFrame) -> DataFrame:
    """YAML files that declare a Kubernetes kind."""
    return df.filter(F.col("ext").isin(".yaml", ".yml") & k8s_manifest(F.col("content"))).select("repo", "path")


def compliance_mentions(df: DataFrame) -> DataFrame:
    """Does a README, a privacy file or a Markdown file name a rule?"""
    name, path = basename(F.col("path")), F.col("path")
    named = (~path.contains("/") & name.rlike("^(README|readme)")) | name.rlike("^(PRIVACY|privacy)")
    is_md = name.endswith(".md")
    return df.filter(named | is_md).groupBy("repo").agg(F.bool_or(F.col("content").rlike(S.COMPLIANCE)).alias("has_gdpr_mention"))


def file_flags(df: DataFrame) -> DataFrame:
    """The flags that follow from paths and YAML contents, one row per repository."""
    name, path = basename(F.col("path")), F.col("path")
    bundle = path.rlike(r"(\.xcodeproj|\.xcworkspace)(/|$)")
    any_of = lambda cond, out: F.bool_or(cond).alias(out)
    return df.groupBy("repo").agg(
        any_of(name.isin(S.DOCKER_NAMES), "has_docker"),
        any_of(_has_dir(S.K8S_DIRS) | (F.col("ext").isin(".yaml", ".yml") & k8s_manifest(F.col("content"))), "has_kubernetes"),
        any_of(name == "AndroidManifest.xml", "has_android"),
        any_of(bundle | (name == "Podfile"), "has_ios"),
        any_of(name.rlike(S.DESKTOP_FILE), "desktop_file"),
        any_of(_has_dir(S.AUTH_DIRS), "auth_dir"),
        any_of(_has_dir(S.TEST_DIRS) | name.rlike(S.TEST_FILE), "has_tests"),
        any_of(name == "index.html", "has_index"))


def infra_files(df: DataFrame) -> DataFrame:
    """Container files, Kubernetes directories and manifests, as distinct rows."""
    name, path = basename(F.col("path")), F.col("path")
    at = F.array_position(F.transform(dirs(F.lower("path")), lambda d: d.isin(S.K8S_DIRS)), True)
    k8s_dir = F.when(at > 0, F.array_join(F.slice(dirs(path), F.lit(1), at.cast("int")), "/"))
    items = F.array_compact(F.array(
        F.when(name.isin(S.DOCKER_NAMES), path), k8s_dir,
        F.when(F.col("ext").isin(".yaml", ".yml") & k8s_manifest(F.col("content")), path)))
    return df.select("repo", F.explode(items).alias("item")).distinct()


def platform(android, ios, desktop, http, grpc, index):
    """B18"""
    return (F.when(android, "android").when(ios, "ios").when(desktop, "desktop")
            .when(http | grpc, "server").when(index, "web").otherwise("library"))


def evidence(df: DataFrame, endpoints: DataFrame, rpcs: DataFrame, deps: DataFrame, build: DataFrame) -> DataFrame:
    """Eleven flags, platform, build tool and language per repository."""
    bucket = dep_bucket(F.col("name"), F.col("category"))
    lower = F.lower("name")
    words = dict(S.DEP_BUCKETS)
    dep_flags = deps.groupBy("repo").agg(
        F.bool_or(contains_any(lower, words["database"])).alias("has_database"),
        F.bool_or(contains_any(lower, words["auth"])).alias("auth_dep"),
        F.bool_or(contains_any(lower, words["grpc"])).alias("grpc_dep"),
        F.bool_or(lower.contains("electron")).alias("electron"), F.count("*").alias("n_deps"))
    count = lambda d, name: d.groupBy("repo").agg(F.count("*").alias(name))
    out = (file_flags(df).join(compliance_mentions(df), "repo", "left").join(dep_flags, "repo", "left")
           .join(count(endpoints, "n_endpoints"), "repo", "left").join(count(rpcs, "n_rpcs"), "repo", "left")
           .join(build, "repo", "left"))
    out = out.na.fill(0, ["n_endpoints", "n_rpcs", "n_deps"]).na.fill(False)
    http = F.col("n_endpoints") > 0
    grpc = (F.col("n_rpcs") > 0) | F.col("grpc_dep")
    desktop = F.col("desktop_file") | F.col("electron")
    return out.select(
        "repo", http.alias("has_http_api"), grpc.alias("has_grpc"), "has_database",
        (F.col("auth_dep") | F.col("auth_dir")).alias("has_auth"), "has_docker", "has_kubernetes",
        "has_android", "has_ios", desktop.alias("has_desktop"), "has_gdpr_mention", "has_tests",
        platform(F.col("has_android"), F.col("has_ios"), desktop, http, grpc, F.col("has_index")).alias("platform"),
        F.coalesce("build_tool", F.lit("unknown")).alias("build_tool"),
        F.coalesce("language", F.lit("unknown")).alias("primary_language"),
        "n_endpoints", "n_rpcs", "n_deps")


def unpivot_flags(ev: DataFrame) -> DataFrame:
    """One row per (repo, flag)."""
    return ev.unpivot(["repo"], FLAGS, "flag", "value")


def stack_labels(deps: DataFrame, ev: DataFrame) -> DataFrame:
    """Language, build tool, platform, Docker, Kubernetes, then eight dependencies.

    At most thirteen rows per repository; equal labels (ignoring case) keep the first.
    """
    known = lambda c, skip=("unknown",): F.when(~F.col(c).isin(*skip), title(F.col(c)))
    base = F.array(known("primary_language"), known("build_tool"), known("platform", ("unknown", "library")),
                   F.when(F.col("has_docker"), "Docker"), F.when(F.col("has_kubernetes"), "Kubernetes"))
    fixed = ev.select("repo", F.posexplode(base).alias("ord", "label")).filter("label is not null")
    shown = F.trim(F.regexp_replace(F.substring_index(F.trim("name"), ":", -1), r"""^[\s"']+|[\s"']+$""", ""))
    usable = deps.filter(~F.col("category").isin(P.STACK_SKIP_CATEGORIES)).withColumn("label", shown) \
        .filter((F.col("label") != "") & ~F.lower("label").isin(P.STACK_SKIP_NAMES))
    picked = top_k(usable.select("repo", "label", "seq"), ["repo"], ["seq"], 8)
    rows = fixed.unionByName(picked.select("repo", (F.col("rank") + 4).alias("ord"), "label"))
    return (rows.groupBy("repo", F.lower("label").alias("key")).agg(F.min(F.struct("ord", "label")).alias("m"))
            .select("repo", "m.ord", "m.label"))


def paths_matching(df: DataFrame, globs) -> DataFrame:
    """(repo, path, glob) of paths that match a glob; ``globs`` is a list of patterns."""
    lower = F.lower("path")
    hits = F.array_compact(F.array(*[F.when(lower.rlike(glob_regex(g)), F.lit(g)) for g in globs]))
    return df.select("repo", "path", F.explode(hits).alias("glob"))


def pack_score(df: DataFrame, deps: DataFrame, ev: DataFrame, packs: dict = P.PACKS, all_scores: bool = False) -> DataFrame:
    """Score of every pack per repository from flags, dependency words and globs.

    Globs and words that occur are collected as distinct (repo, rule) pairs, so the tables
    that meet are bounded by the number of rules.
    """
    globs = [(p, g) for p, (_, _, _, gs) in packs.items() for g in gs]
    words = [(p, w) for p, (_, _, ws, _) in packs.items() for w in ws]
    lower, name = F.lower("path"), F.lower("name")

    def hits(table, rules, test, out):
        cols = F.array_distinct(F.array_compact(F.array(*[F.when(test(r), F.struct(F.lit(p).alias("pack"), F.lit(r).alias("rule")))
                                                          for p, r in rules])))
        return (table.select("repo", F.explode(cols).alias("h")).distinct()
                .groupBy("repo", F.col("h.pack").alias("pack")).agg(F.count("*").alias(out)))

    by_glob = hits(df, globs, lambda g: lower.rlike(glob_regex(g)), "globs")
    by_word = hits(deps, words, lambda w: name.contains(w.lower()), "words")
    rows = []
    for pack, (threshold, flags, _, _) in packs.items():
        n = sum((F.when(F.col(f), 1).otherwise(0) for f in flags), F.lit(0))
        # thousandths, rounded the same way everywhere
        rows.append(F.struct(F.lit(pack).alias("pack"), F.lit(int(round(threshold * 1000))).alias("threshold"),
                             (F.floor(n * 1000 / len(flags)) if flags else F.lit(0)).cast("int").alias("flag")))
    out = ev.select("repo", F.explode(F.array(*rows)).alias("p")).select("repo", "p.*")
    out = out.join(by_glob, ["repo", "pack"], "left").join(by_word, ["repo", "pack"], "left").na.fill(0, ["globs", "words"])
    dep = F.when(F.col("words") >= 3, 1000).when(F.col("words") == 2, 800).when(F.col("words") == 1, 600).otherwise(0)
    glob = F.when(F.col("globs") >= 3, 1000).when(F.col("globs") == 2, 700).when(F.col("globs") == 1, 500).otherwise(0)
    firing = sum((F.when(c > 0, 1).otherwise(0) for c in (F.col("flag"), dep, glob)), F.lit(0))
    best = F.greatest(F.col("flag"), dep, glob)
    total = F.when(firing >= 2, F.least(F.lit(1000), best + 150)).otherwise(best)
    out = out.withColumn("points", total)
    if not all_scores:
        out = out.filter(F.col("points") >= F.col("threshold"))
    return out.select("repo", "pack", (F.col("points") / 1000).alias("score"))


def evidence_fingerprint(ev: DataFrame, framework: str = "") -> DataFrame:
    """Eight hex digits over nine signals; equal repositories get equal digits."""
    cols = ["platform", "primary_language", "has_http_api", "has_grpc", "has_android", "has_ios", "has_database", "build_tool"]
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cols]
    text = F.concat_ws(";", *parts, F.lit(f"framework={framework}"))
    return ev.select("repo", md5_fingerprint(text).alias("fingerprint"))
