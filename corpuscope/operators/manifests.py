"""Dependencies from build files, package metadata and the intent of a repository."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import basename
from ..functions.text import clean_dep_name, contains_any, top_docstring
from ..rules import signals as S
from .numbering import top_k
from .signals import matches

DEP = "array<struct<section:int,name:string,version:string,category:string>>"


def dep_category(group: Column, artifact: Column) -> Column:
    """Category by fragments of ``group:artifact``, first match wins."""
    key = F.lower(F.concat(group, F.lit(":"), artifact))
    out = None
    for category, fragments in S.DEP_CATEGORY:
        cond = contains_any(key, fragments)
        out = F.when(cond, category) if out is None else out.when(cond, category)
    return out.otherwise("library")


def dep_bucket(name: Column, category: Column) -> Column:
    """Database > auth > grpc > infra > framework > other."""
    lower, out = F.lower(name), None
    for bucket, fragments in S.DEP_BUCKETS:
        cond = contains_any(lower, fragments)
        out = F.when(cond, bucket) if out is None else out.when(cond, bucket)
    return out.when(category == "framework", "framework").otherwise("other")


def _dep(section, name, version, category):
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(section).alias("section"), lit(name).alias("name"), lit(version).alias("version"), lit(category).alias("category"))


def _gradle(content: Column) -> Column:
    plugin = matches(content, S.GRADLE_PLUGIN, (1, 2, 3, 4), ("short", "kv", "id", "pv"))
    plugins = F.transform(plugin, lambda m: F.when(
        m["short"] != "", _dep(0, F.concat(F.lit("kotlin-"), clean_dep_name(m["short"])), clean_dep_name(m["kv"]), "language")).otherwise(
        _dep(0, clean_dep_name(F.substring_index(m["id"], ".", -1)), clean_dep_name(m["pv"]),
             F.when(F.lower(m["id"]).contains("spring"), "framework").otherwise("build"))))
    ext = F.transform(matches(content, S.GRADLE_EXT, (1, 2), ("name", "version")), lambda m: _dep(
        1, clean_dep_name(m["name"]), clean_dep_name(m["version"]),
        F.when(F.lower(m["name"]).contains("kotlin"), "language").otherwise("framework")))
    gav = F.transform(matches(content, S.GRADLE_DEP, (1, 2, 3), ("group", "artifact", "version")), lambda m: _dep(
        2, F.concat(clean_dep_name(m["group"]), F.lit(":"), clean_dep_name(m["artifact"])), clean_dep_name(m["version"]),
        dep_category(clean_dep_name(m["group"]), clean_dep_name(m["artifact"]))))
    jvm = F.transform(F.regexp_extract_all(content, F.lit(S.GRADLE_JVM), F.lit(1)),
                      lambda v: _dep(3, "jvm-target", clean_dep_name(v), "language"))
    return F.concat(plugins, ext, gav, jvm)


def _maven(content: Column) -> Column:
    parent = F.transform(matches(content, S.MAVEN_PARENT, (1, 2), ("name", "version")),
                         lambda m: _dep(0, m["name"], m["version"], "framework"))
    gav = F.filter(matches(content, S.MAVEN_GAV, (1, 2, 3), ("group", "artifact", "version")),
                   lambda m: ~m["version"].contains("${"))
    return F.concat(parent, F.transform(gav, lambda m: _dep(
        1, F.concat(m["group"], F.lit(":"), m["artifact"]), m["version"], dep_category(m["group"], m["artifact"]))))


def _npm(content: Column) -> Column:
    maps = F.from_json(content, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    part = lambda i, key: F.transform(F.map_entries(F.coalesce(maps[key], F.expr("cast(map() as map<string,string>)"))),
                                      lambda e: _dep(i, e["key"], F.regexp_replace(e["value"], r"^[\^~]+", ""), "library"))
    return F.concat(part(0, "dependencies"), part(1, "devDependencies"))


def _pip(content: Column) -> Column:
    lines = F.filter(F.transform(F.split(content, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
                     lambda x: (x != "") & ~x.startswith("#"))
    return F.transform(lines, lambda x: _dep(
        0, F.trim(F.regexp_extract(x, r"^([^=<>!~]*)", 1)),
        F.when(x.rlike("[=<>!~]"), F.trim(F.regexp_extract(x, r"^[^=<>!~]*[=<>!~]+(.*)$", 1))).otherwise("unspecified"), "library"))


MANIFESTS = [("gradle", ["build.gradle", "build.gradle.kts"], _gradle), ("maven", ["pom.xml"], _maven),
             ("npm", ["package.json"], _npm), ("pip", ["requirements.txt"], _pip)]


def declared_dependencies(df: DataFrame, tools=None) -> DataFrame:
    """Every declaration with its place: tool, file, section and position."""
    name = basename(F.col("path"))
    picked = [(i, *m) for i, m in enumerate(MANIFESTS) if tools is None or m[0] in tools]
    kept = df.filter(name.isin([n for _, _, names, _ in picked for n in names]))
    found, rank, tool = None, None, None
    for i, label, names, parse in picked:
        cond, deps = name.isin(names), parse(F.col("content")).cast(DEP)
        found = F.when(cond, deps) if found is None else found.when(cond, deps)
        rank = F.when(cond, i) if rank is None else rank.when(cond, i)
        tool = F.when(cond, label) if tool is None else tool.when(cond, label)
    rows = kept.select("repo", F.col("path").alias("manifest"), rank.alias("rank"), tool.alias("tool"),
                       F.posexplode(found).alias("pos", "d"))
    return rows.select("repo", "tool", "manifest", "d.name", "d.version", "d.category", "rank", "pos")


def gradle_deps(df):
    """C8"""
    return declared_dependencies(df, ["gradle"])


def maven_deps(df):
    """C9"""
    return declared_dependencies(df, ["maven"])


def npm_deps(df):
    """C10"""
    return declared_dependencies(df, ["npm"])


def pip_deps(df):
    """C11"""
    return declared_dependencies(df, ["pip"])


def dependencies(df: DataFrame) -> DataFrame:
    """First declaration of every (lower name, version) in tool, file and position order.

    ``seq`` keeps that order for later limits.
    """
    rows = declared_dependencies(df).withColumn("seq", F.struct("rank", "manifest", "pos"))
    return (rows.groupBy("repo", F.lower("name").alias("key"), "version")
            .agg(F.min_by(F.struct("name", "category", "manifest", "seq"), "seq").alias("d"))
            .select("repo", "d.name", "version", "d.category", "d.manifest", "d.seq"))


def build_facts(df: DataFrame) -> DataFrame:
    """Build tool, primary language and jcenter use per repository that has a build file."""
    name, content = basename(F.col("path")), F.col("content")
    has = {label: F.bool_or(name.isin(names)) for label, names, _ in MANIFESTS}
    kept = df.filter(name.isin([n for _, names, _ in MANIFESTS for n in names]))
    gradle = name.isin(MANIFESTS[0][1])
    plugins = matches(content, S.GRADLE_PLUGIN, (1, 3), ("short", "id"))
    vars_ = F.regexp_extract_all("content", F.lit(S.GRADLE_EXT), F.lit(1))
    kotlin = gradle & (F.exists(plugins, lambda m: (m["short"] != "") | F.lower(m["id"]).contains("kotlin"))
                       | F.exists(vars_, lambda v: F.lower(v).contains("kotlin")))
    out = kept.groupBy("repo").agg(*[c.alias(k) for k, c in has.items()], F.bool_or(kotlin).alias("kotlin"),
                                   F.bool_or(gradle & content.rlike(S.JCENTER)).alias("uses_jcenter"))
    tool = F.when(F.col("gradle"), "gradle").when(F.col("maven"), "maven").when(F.col("npm"), "npm").otherwise("pip")
    language = (F.when(F.col("kotlin"), "kotlin").when(F.col("npm"), "javascript")
                .when(F.col("pip"), "python").otherwise("unknown"))
    return out.select("repo", tool.alias("build_tool"), language.alias("language"), "uses_jcenter")


def dep_buckets(deps: DataFrame) -> DataFrame:
    """Distinct dependency names per bucket, as rows."""
    return deps.select("repo", dep_bucket(F.col("name"), F.col("category")).alias("bucket"), "name").distinct()


def package_metadata(df: DataFrame) -> DataFrame:
    """Name, description and keywords of the first root manifest that can be read."""
    path, content = F.col("path"), F.col("content")
    js = F.from_json("content", "struct<name:string,description:string,keywords:array<string>>")
    toml = lambda key: F.regexp_extract("content", key + r'\s*=\s*"([^"]+)"', 1)
    others = ["pyproject.toml", "Cargo.toml"]
    ranks = F.when((path == "package.json") & F.get_json_object("content", "$").isNotNull(), 0)
    for i, name in enumerate(others):
        ranks = ranks.when(path == name, i + 1)
    pick = lambda key: F.when(F.col("rank") == 0, F.coalesce(js[key], F.lit(""))).otherwise(toml(key))
    rows = df.filter(path.isin("package.json", *others)).withColumn("rank", ranks).filter("rank is not null")
    rows = rows.select("repo", "rank", F.col("path").alias("source"), pick("name").alias("package_name"),
                       pick("description").alias("package_description"),
                       F.when(F.col("rank") == 0, F.coalesce(F.array_join(js["keywords"], ","), F.lit(""))).otherwise("").alias("keywords"))
    body = F.struct("source", "package_name", "package_description", "keywords")
    return rows.groupBy("repo").agg(F.min_by(body, "rank").alias("m")).select("repo", "m.*")


def intent_waterfall(df: DataFrame) -> DataFrame:
    """README, else the docstring of an entry point, else nothing; with a confidence note."""
    path = F.col("path")
    rank_in = lambda names: F.array_position(F.array(*[F.lit(n) for n in names]), path)
    first = lambda names, value: (df.filter(path.isin(names)).groupBy("repo")
                                  .agg(F.min_by(F.struct(path.alias("name"), value.alias("text")), rank_in(names)).alias("f"))
                                  .select("repo", "f.name", "f.text"))
    readme = first(S.README_NAMES, F.col("content")).filter(F.regexp_replace("text", r"\s", "") != "") \
        .select("repo", F.col("name").alias("readme_name"), F.col("text").alias("readme"))
    entry = first(S.ENTRY_NAMES, top_docstring(F.col("content"))).filter("text <> ''") \
        .select("repo", F.col("text").alias("doc"))
    meta = package_metadata(df).select("repo", "package_name", "package_description")
    out = (df.select("repo").distinct().join(readme, "repo", "left").join(entry, "repo", "left").join(meta, "repo", "left"))
    text = F.coalesce("readme", F.concat(F.lit("[Extracted from entry point]\n"), "doc"), F.lit(""))
    source = F.coalesce("readme_name", F.when(F.col("doc").isNotNull(), "entry_point_docstring"), F.lit("none"))
    description = F.coalesce("package_description", F.lit(""))
    note = (F.when(text != "", F.concat(F.lit("README present (source: "), source, F.lit(") — high confidence context.")))
            .when(description != "", F.concat(F.lit("No README found. Context derived from package manifest: '"), description, F.lit("'")))
            .otherwise("[NO_DOCUMENTATION] No README or package description found. Infer from structure only. Assign lower confidence to all features."))
    return out.select("repo", text.alias("intent"), source.alias("source"), F.coalesce("package_name", F.lit("")).alias("package_name"),
                      description.alias("package_description"), note.alias("confidence_note"))
