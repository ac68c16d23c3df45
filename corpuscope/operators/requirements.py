"""Requirements: functional, non-functional, and the ones derived from the final record."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import top_dir
from ..functions.text import contains_any, display, humanize, numbered
from ..rules import documents as D, packs as P
from .features import moscow
from .modules import normal_module_files
from .numbering import batches, number_rows, top_k, with_ids

TEMPLATE = "array<struct<description:string,acceptance:array<string>>>"


def _template(rows, shown=None) -> Column:
    fill = lambda t: F.lit(t) if shown is None or "{name}" not in t else F.concat(
        *[p for i, piece in enumerate(t.split("{name}")) for p in (([shown] if i else []) + [F.lit(piece)])])
    return F.array(*[F.struct(fill(d).alias("description"), F.array(*[fill(a) for a in acc]).alias("acceptance"))
                     for d, acc in rows]).cast(TEMPLATE)


def functional_requirements(features: DataFrame) -> DataFrame:
    """Template rows of a known feature, else two general ones; 3, 2 or 1 by confidence."""
    rows = None
    name = F.lower("name")
    for known, template in D.FR_TEMPLATES.items():
        rows = F.when(name == known, _template(template)) if rows is None else rows.when(name == known, _template(template))
    rows = rows.otherwise(_template(D.FR_GENERIC, display(F.col("name"))))
    cap = F.when(F.col("conf") >= 80, 3).when(F.col("conf") >= 50, 2).otherwise(1)
    out = features.filter("name <> ''").select("repo", F.col("name").alias("linked_feature"), F.col("ord").alias("feature_ord"),
                                               F.posexplode(F.slice(rows, F.lit(1), cap)).alias("pos", "t"))
    out = out.select("repo", "linked_feature", "feature_ord", "pos", "t.description", "t.acceptance")
    return with_ids(out, ["repo"], ["feature_ord", "pos"], "FR-", 0, "req_id").withColumnRenamed("n", "ord")


def nonfunctional_requirements(labels: DataFrame, repos: DataFrame) -> DataFrame:
    """Base rows, rows triggered by the technology labels, fillers up to six, eight at most."""
    label = F.lower("label")
    flags = labels.groupBy("repo").agg(*[F.bool_or(contains_any(label, words)).alias(group) for group, words, _ in D.NFR_BY_STACK])
    out = repos.select("repo").distinct().join(flags, "repo", "left").na.fill(False)
    row = lambda c, d: F.struct(F.lit(c).alias("category"), F.lit(d).alias("description"))
    base = F.array(*[row(*r) for r in D.NFR_BASE])
    triggered = F.array_compact(F.array(*[F.when(F.col(group), row(*r)) for group, _, rows in D.NFR_BY_STACK for r in rows]))
    chosen = F.concat(base, triggered)
    full = F.slice(F.when(F.size(chosen) < 6, F.concat(chosen, F.array(*[row(*r) for r in D.NFR_FILL]))).otherwise(chosen), 1, 8)
    return out.select("repo", F.posexplode(full).alias("pos", "r")).select(
        "repo", numbered("NFR-", F.col("pos") + 1).alias("req_id"), "r.category", "r.description", (F.col("pos") + 1).alias("ord"))


def path_category(path: Column) -> Column:
    lower, out = F.lower(path), None
    for fragment, category in P.CATEGORY_FRAGMENTS:
        cond = lower.contains(fragment)
        out = F.when(cond, category) if out is None else out.when(cond, category)
    return out


def feature_category(sources: DataFrame, keys) -> DataFrame:
    """Category of the first source, in order, that names one; ``sources`` has ord and source."""
    named = sources.withColumn("category", path_category(F.col("source")))
    return named.groupBy(*keys).agg(F.coalesce(F.min_by("category", F.when(F.col("category").isNotNull(), F.col("ord"))),
                                               F.lit("unknown")).alias("category"))


def requirement_priority(category: Column, conf: Column) -> Column:
    """A weak High becomes Medium; other very weak ones become Low."""
    base = F.lit("Low")
    for name, value in P.CATEGORY_PRIORITY.items():
        base = F.when(category == name, value).otherwise(base)
    return F.when((conf < 40) & (base == "High"), "Medium").when(conf < 20, "Low").otherwise(base)


def payload_features(members: DataFrame, modules_norm: DataFrame, validation: DataFrame) -> DataFrame:
    """One feature per module plus the structure check as a feature of its own."""
    files = normal_module_files(members)
    sources = (files.select("repo", "name", F.struct(F.lit(0).alias("k"), "path").alias("ord"), F.col("path").alias("source"))
               .unionByName(modules_norm.select("repo", "name", F.struct(F.lit(1).alias("k"), F.lit("").alias("path")).alias("ord"), F.col("name").alias("source"))))
    category = feature_category(sources, ["repo", "name"])
    mods = modules_norm.join(category, ["repo", "name"]).select(
        "repo", F.lit(0).alias("kind"), F.col("name").alias("module"), humanize(F.col("name")).alias("name"),
        F.round(F.col("confidence") * 100).cast("int").alias("conf"), "n_files", "category")
    meta = validation.select("repo", F.lit(1).alias("kind"), F.lit("").alias("module"), F.lit("Structural Validation Quality").alias("name"),
                             F.round(F.col("score") * 100).cast("int").alias("conf"), F.lit(1).cast("long").alias("n_files"),
                             F.lit("core_pipeline").alias("category"))
    return with_ids(mods.unionByName(meta), ["repo"], ["kind", "module"], "feat-", 3, "feature_id").withColumnRenamed("n", "ord")


def payload_requirements(features: DataFrame) -> DataFrame:
    """One requirement per feature."""
    conf = (F.col("conf") / 100)
    text = F.concat(F.lit("The system SHALL implement the '"), "name", F.lit("' capability as evidenced by "),
                    F.col("n_files").cast("string"), F.lit(" source file(s) with a structural confidence of "), conf.cast("string"), F.lit("."))
    return features.select("repo", numbered("REQ-", F.col("ord"), 3).alias("req_id"), "feature_id", text.alias("description"),
                           requirement_priority(F.col("category"), F.col("conf")).alias("priority"))


def requirement_modules(members: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct top directories behind every requirement, as rows."""
    files = normal_module_files(members).select("repo", F.col("name").alias("module"), top_dir(F.col("path")).alias("source_module")).distinct()
    return features.filter("kind = 0").join(files, ["repo", "module"]).select(
        "repo", numbered("REQ-", F.col("ord"), 3).alias("req_id"), "source_module")


def system_summary(modules_norm: DataFrame, repos: DataFrame) -> DataFrame:
    """One line per repository: how many modules, and the first three names."""
    lead = top_k(modules_norm.select("repo", "name"), ["repo"], ["name"], 3)
    names = lead.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("lead"))  # three at most
    count = modules_norm.groupBy("repo").agg(F.count("*").alias("n"))
    out = repos.select("repo").distinct().join(count, "repo", "left").join(names, "repo", "left")
    n = F.coalesce("n", F.lit(0))
    shown = F.when(n <= 3, F.col("lead")).otherwise(F.concat("lead", F.lit(", and "), (n - 3).cast("string"), F.lit(" more")))
    return out.select("repo", F.when(n == 0, F.concat("repo", F.lit(": A software repository with no detected structural modules.")))
                      .otherwise(F.concat("repo", F.lit(": A system comprising "), n.cast("string"), F.lit(" structural module(s) ("), shown, F.lit(")."))).alias("summary"))


def glossary(terms: DataFrame) -> DataFrame:
    """The first definition of every term; ``terms`` has (repo, term, definition, ord)."""
    return terms.filter("term <> '' and definition <> ''").groupBy("repo", "term").agg(F.min_by("definition", "ord").alias("definition"))


def requirement_confidence(frs: DataFrame, features: DataFrame) -> DataFrame:
    """Requirements with the confidence of their feature, 0.7 where it is unknown."""
    conf = features.groupBy("repo", F.col("name").alias("linked_feature")).agg(
        F.max_by("conf", "ord").alias("conf"), F.max_by("description", "ord").alias("feature_text"))
    return (frs.join(conf, ["repo", "linked_feature"], "left").withColumn("conf", F.coalesce("conf", F.lit(70)))
            .withColumn("feature_text", F.coalesce("feature_text", F.lit(""))))


def requirement_enrichment(frs: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Texts of an enrichment table replace the own ones field by field."""
    e = enrichment.select("repo", "req_id", *[F.col(c).alias(f"e_{c}") for c in ("plain", "technical", "impact", "acceptance")])
    own = F.col("description")
    return frs.join(e, ["repo", "req_id"], "left").select(
        *frs.columns, F.coalesce("e_plain", own).alias("plain"), F.coalesce("e_technical", own).alias("technical"),
        F.coalesce("e_impact", F.lit("Required for system operation.")).alias("impact"),
        F.coalesce("e_acceptance", F.get("acceptance", F.lit(0))).alias("verified_by"))


def requirement_table(features: DataFrame, frs: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """Requirement rows with priority and the first acceptance criterion."""
    rows = requirement_confidence(frs, features)
    if enrichment is None:
        rows = rows.select("*", F.col("description").alias("plain"), F.col("description").alias("technical"),
                           F.lit("Required for system operation.").alias("impact"), F.get("acceptance", F.lit(0)).alias("verified_by"))
    else:
        rows = requirement_enrichment(rows, enrichment)
    return rows.select("repo", "ord", "feature_ord", "req_id", display(F.col("linked_feature")).alias("feature"), "feature_text", "plain",
                       "technical", "impact", moscow(F.col("conf")).alias("priority"), "verified_by")


def requirement_batches(frs: DataFrame, size: int = 8) -> DataFrame:
    """requirements in ordered batches for later steps."""
    return batches(frs.select("repo", "req_id", "ord"), ["repo"], ["ord"], size).select("repo", "req_id", "batch")
