"""Features: fallback, calibration, dedupe and merge, interpretation, product and business views.

A feature row is (repo, feature_id, name, description, conf, ord). ``conf`` is confidence in
hundredths, an integer, so that no rounding depends on binary fractions. Source modules and
merged ids are rows of their own tables, since their number has no upper bound.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import (contains_any, display, feature_key, lit_array, numbered, snake, title,
                              title_with_acronyms, trim_to_words)
from ..rules import packs as P, signals as S
from ..session import fixed_rows, hold
from .chunks import chunk_array
from .classify import negative_path
from .names import salted_join, with_names
from .numbering import number_rows, top_k, with_ids


def moscow(conf: Column) -> Column:
    """B12"""
    return F.when(conf >= 80, "Must Have").when(conf >= 60, "Should Have").otherwise("Could Have")


def component_layer(name: Column) -> Column:
    """Layer of a component by fragments of its name, first match wins."""
    out = None
    for layer, fragments in P.LAYERS:
        cond = contains_any(name, fragments)
        out = F.when(cond, layer) if out is None else out.when(cond, layer)
    return out.otherwise("Application Layer")


def fallback_features(modules_norm: DataFrame) -> DataFrame:
    """One feature per normalized module; the module is its only source."""
    out = modules_norm.select(
        "repo", F.concat(title(F.replace("name", F.lit("_"), F.lit(" "))), F.lit(" Component")).alias("name"),
        F.concat(F.lit("Core architectural component encompassing "), "name", F.lit(".")).alias("description"),
        F.lit(70).alias("conf"), F.col("name").alias("source"))
    return with_ids(out, ["repo"], ["source"], "feat-", 3, "feature_id").withColumnRenamed("n", "ord")


def feature_sources(features: DataFrame) -> DataFrame:
    return features.select("repo", "feature_id", "source")


# ---- matching features and files -----------------------------------------------------

def contains_join(hay: DataFrame, hay_col: str, needles: DataFrame, needle_col: str, keys, shortest: int = 1) -> DataFrame:
    """Rows of ``hay`` joined to ``needles`` they contain, as an equi join.

    A needle is looked up by its first three characters among the three-character pieces of
    the haystack (shorter needles by all they have), then checked. No cross product, and a
    pair cannot come twice because pieces are distinct. Meant for short haystacks such as
    words and names. ``shortest`` is the length of the shortest needle, if that is known.
    """
    n = needles.filter(F.length(needle_col) > 0).withColumn("_piece", F.substring(needle_col, 1, 3))
    text = F.col(hay_col)
    pieces = F.array_distinct(F.flatten(F.transform(lit_array(range(min(shortest, 3), 4)), lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1)), lambda i: F.substring(text, i, k)))))
    h = hay.withColumn("_piece", F.explode(pieces))
    return h.join(n, [*keys, "_piece"]).filter(F.col(hay_col).contains(F.col(needle_col))).drop("_piece")


def feature_keywords(features: DataFrame) -> DataFrame:
    """Distinct keywords (three letters or more) of a feature name."""
    kws = F.array_distinct(F.filter(F.split(feature_key(F.col("name")), "_"), lambda k: F.length(k) >= 3))
    return features.select("repo", "feature_id", F.explode(kws).alias("keyword"))


def file_keywords(features: DataFrame, classified: DataFrame, head: int | None = None, limit: int = S.CHUNK_CHARS) -> DataFrame:
    """(repo, path, neg, keywords) of the files that hold a keyword of a feature of their repository.

    The keywords of all features are looked for in the lower-case path and content by one
    automaton, in the row of the file; ``head`` looks only at the first characters of each chunk.
    """
    content = F.lower("content") if head is None else F.array_join(
        F.transform(chunk_array(F.col("content"), limit), lambda c: F.substring(F.lower(c), 1, head)), "\n")
    text = F.concat_ws("\n", F.lower("path"), content)
    own = feature_keywords(features).select("repo", "keyword").distinct()
    files = classified.select("repo", "path", negative_path(F.lower("path")).cast("int").alias("neg"), text.alias("text"))
    told = with_names(files, own.select(F.col("keyword").alias("name")), key=["repo", "path"], out="told")
    rows = told.select("repo", "path", "neg", F.explode("told").alias("keyword"))
    kept = salted_join(rows, own, ["repo", "keyword"], key="path")
    return kept.groupBy("repo", "path", "neg").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def feature_file_counts(features: DataFrame, classified: DataFrame, head: int | None = None) -> DataFrame:
    """D3: files that mention a feature, and how many of them look like tests.

    A word like ``service`` is shared by many features and many files, so the two are never paired:
    files count by the set of keywords they hold, features by the set they ask for, and only
    different sets meet, by an equi join on their keywords that is salted by the set of the files.
    A set of files counts once for a feature, whatever number of keywords they share.
    """
    found = file_keywords(features, classified, head)
    held = hold(found.groupBy("repo", "keywords").agg(F.count("*").alias("n"), F.sum("neg").alias("n_neg")))
    asked = feature_keywords(features).groupBy("repo", "feature_id").agg(F.array_sort(F.collect_set("keyword")).alias("asked"))  # keywords of one name
    sets = asked.select("repo", "asked").distinct()
    groups = held.select("repo", "keywords", "n", "n_neg", F.explode("keywords").alias("keyword"))
    met = salted_join(groups, sets.select("repo", "asked", F.explode("asked").alias("keyword")), ["repo", "keyword"], key="keywords")
    counts = met.select("repo", "asked", "keywords", "n", "n_neg").distinct().groupBy("repo", "asked").agg(F.sum("n").alias("n_files"), F.sum("n_neg").alias("n_negative"))
    return asked.join(counts, ["repo", "asked"]).select("repo", "feature_id", "n_files", "n_negative")


def calibrate_confidence(features: DataFrame, sources: DataFrame, classified: DataFrame, head: int | None = None) -> DataFrame:
    """Confidence by presence in files and by how much of the evidence is tests or mocks."""
    counts = feature_file_counts(features, classified, head)
    per_source = sources.groupBy("repo", "feature_id").agg(
        F.count("*").alias("n_src"), F.count_if(negative_path(F.col("source"))).alias("n_src_neg"))
    out = features.join(counts, ["repo", "feature_id"], "left").join(per_source, ["repo", "feature_id"], "left") \
        .na.fill(0, ["n_files", "n_negative", "n_src", "n_src_neg"])
    n, src, neg = F.col("n_files"), F.col("n_src"), F.col("n_src_neg")
    delta = (F.when(n >= 6, 10).when(n >= 3, 5).when(n == 0, -10).otherwise(0)
             + F.when((src > 0) & (neg == src), -20).when(neg > 0, -10).otherwise(0)
             + F.when((n > 0) & (F.col("n_negative") * 10 >= n * 8), -10).otherwise(0))
    usable = F.size(F.filter(F.split(feature_key(F.col("name")), "_"), lambda k: F.length(k) >= 3)) > 0
    conf = F.when(usable, F.greatest(F.lit(10), F.least(F.lit(100), F.col("conf") + delta))).otherwise(F.col("conf"))
    return out.withColumn("conf", conf.cast("int")).select(*features.columns, "n_files", "n_negative")


# ---- dedupe, merge, validate -----------------------------------------------------------

def _group(features: DataFrame, key, name: Column) -> DataFrame:
    """Best member per key: highest confidence, the first one on a tie. One partial aggregate."""
    best = F.struct("conf", (-F.col("ord")).alias("first"))
    return features.groupBy("repo", key.alias("key")).agg(
        F.max_by(F.struct(name.alias("name"), "description"), best).alias("b"), F.max("conf").alias("conf"),
        F.min("ord").alias("ord"), F.sum("members").alias("members")).select(
            "repo", "key", "b.name", "b.description", "conf", "ord", "members")


def _members(features: DataFrame) -> DataFrame:
    return features if "members" in features.columns else features.withColumn("members", F.lit(1))


def dedupe_features(features: DataFrame) -> DataFrame:
    """One row per name, ignoring case."""
    return _group(_members(features), F.lower("name"), F.col("name"))


def merge_group(name: Column) -> Column:
    """Display name of the synonym group of a feature name, else null."""
    table = F.create_map(*[F.lit(x) for pair in P.MERGE_GROUPS.items() for x in pair])
    return F.try_element_at(table, snake(name))


def merge_features(features: DataFrame) -> DataFrame:
    """Features of a synonym group become one, under the display name of the group."""
    group = merge_group(F.col("name"))
    key = F.coalesce(F.concat(F.lit("group:"), group), F.lower("name"))
    return _group(_members(features), key, F.coalesce(group, F.col("name")))


def validate_features(features: DataFrame) -> DataFrame:
    """Dedupe, merge, snake names, order by confidence and name, new ids."""
    out = merge_features(dedupe_features(features)).withColumn("name", snake(F.col("name")))
    out = with_ids(out.drop("ord"), ["repo"], [F.desc("conf"), "name", "key"], "feat-", 3, "feature_id")
    return out.withColumnRenamed("n", "ord").select("repo", "feature_id", "key", "name", "description", "conf", "ord", "members")


def merge_members(features: DataFrame, validated: DataFrame) -> DataFrame:
    """Which input ids went into which validated feature, as rows."""
    group = merge_group(F.col("name"))
    keyed = features.select("repo", F.col("feature_id").alias("merged_id"),
                            F.coalesce(F.concat(F.lit("group:"), group), F.lower("name")).alias("key"))
    return keyed.join(validated.select("repo", "key", "feature_id"), ["repo", "key"]).select("repo", "feature_id", "merged_id")


def prune_features(features: DataFrame, valid_ids: DataFrame) -> DataFrame:
    """Keep the features whose id is listed."""
    return features.join(valid_ids.select("repo", "feature_id").distinct(), ["repo", "feature_id"], "left_semi")


def merge_skill_features(features: DataFrame, extra: DataFrame) -> DataFrame:
    """Append pack features whose name is new, numbered after the existing ones."""
    key = feature_key(F.col("name"))
    fresh = extra.filter("name <> ''").withColumn("key", key) \
        .join(features.select("repo", key.alias("key")).distinct(), ["repo", "key"], "left_anti")
    fresh = fresh.groupBy("repo", "key").agg(F.min_by(F.struct("name", "description", "conf", "ord"), "ord").alias("f")) \
        .select("repo", "f.*")
    used = features.groupBy("repo").agg(F.max("ord").alias("used"))
    placed = number_rows(fresh.drop("ord").withColumn("k", F.lower("name")), ["repo"], ["k", "name"], "n") \
        .join(used, "repo", "left")
    place = (F.coalesce("used", F.lit(0)) + F.col("n")).cast("int")
    added = placed.select("repo", numbered("feat-", place, 3).alias("feature_id"), "name", "description", "conf", place.alias("ord"))
    return features.select("repo", "feature_id", "name", "description", "conf", "ord").unionByName(added)


# ---- interpretation -------------------------------------------------------------------

def module_matches(signals: DataFrame, signal_files: DataFrame, module_files: DataFrame) -> DataFrame:
    """(repo, signal_id, module, by, via): every file or name by which a module answers to a signal."""
    plain = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    by_file = signal_files.join(module_files.select("repo", "path", F.col("name").alias("module")), ["repo", "path"]) \
        .select("repo", "signal_id", "module", F.lit("file").alias("by"), F.col("path").alias("via"))
    names = module_files.select("repo", F.col("name").alias("module")).distinct().withColumn("hay", plain("module"))
    needles = signals.select("repo", "signal_id", plain("name").alias("needle"), F.col("name").alias("via"))
    by_name = contains_join(names, "hay", needles, "needle", ["repo"]).select("repo", "signal_id", "module", F.lit("name").alias("by"), "via")
    return by_file.unionByName(by_name)


def signal_modules(signals: DataFrame, signal_files: DataFrame, module_files: DataFrame) -> DataFrame:
    """Modules that hold a file of the signal, or whose name contains the signal's name."""
    return module_matches(signals, signal_files, module_files).select("repo", "signal_id", "module").distinct()


def pool_matches(signals: DataFrame, pool: DataFrame) -> DataFrame:
    """(repo, signal_id, item, via): pool items that the name or the description of a signal mentions.

    Items are looked up by their first characters among the pieces of these short texts, so
    signals and items are not paired.
    """
    items = pool.select("repo", "item", F.lower("item").alias("needle")).distinct()
    told = [contains_join(signals.select("repo", "signal_id", F.lower(where).alias("hay")), "hay", items, "needle", ["repo"])
            .select("repo", "signal_id", "item", F.lit(where).alias("via")) for where in ("name", "description")]
    return told[0].unionByName(told[1])


def interpretation_evidence(signals: DataFrame, signal_files: DataFrame, module_files: DataFrame, pool: DataFrame) -> DataFrame:
    """(repo, feature_id, signal_id, kind, item, by, via): what each interpreted feature rests on, and why.

    ``kind`` is a file of the signal, a module or an item of the pool; a module has a row for every
    file it shares with the signal and one if its name holds the signal's. Ids count all signals of
    a repository, so a feature keeps its id when another one finds evidence.
    """
    own = signal_files.select("repo", "signal_id", F.lit("file").alias("kind"), F.col("path").alias("item"), F.lit("signal").alias("by"), F.col("path").alias("via"))
    modules = module_matches(signals, signal_files, module_files).select("repo", "signal_id", F.lit("module").alias("kind"), F.col("module").alias("item"), "by", "via")
    pooled = pool_matches(signals, pool).select("repo", "signal_id", F.lit("pool").alias("kind"), "item", F.lit("mention").alias("by"), "via")
    ids = with_ids(signals.select("repo", "signal_id"), ["repo"], ["signal_id"], "feat-int-", 3, "feature_id").select("repo", "signal_id", "feature_id")
    return own.unionByName(modules).unionByName(pooled).distinct().join(ids, ["repo", "signal_id"]).select(
        "repo", "feature_id", "signal_id", "kind", "item", "by", "via")


def interpret_features(signals: DataFrame, signal_files: DataFrame, module_files: DataFrame, pool: DataFrame) -> DataFrame:
    """Signals with evidence become features; weak evidence lowers the confidence.

    ``pool`` holds (repo, item): entry points, technologies and the system type. Its items
    count when the name or the description mentions them. The evidence itself is rows of
    ``interpretation_evidence``; here it is counted.
    """
    rows = interpretation_evidence(signals, signal_files, module_files, pool)
    facts = rows.groupBy("repo", "signal_id", "feature_id").agg(
        F.count_distinct("item").alias("n_evidence"), F.count_distinct(F.when(F.col("kind") == "module", F.col("item"))).alias("n_modules"))
    out = signals.join(facts, ["repo", "signal_id"])
    tenths = F.when(F.col("n_modules") == 0, 7).when(F.col("n_evidence") == 1, 9).otherwise(10)
    conf = F.greatest(F.lit(10), F.least(F.lit(100), F.floor((F.col("conf") * tenths + 5) / 10))).cast("int")
    return out.select("repo", "feature_id", "signal_id", "name", "description", conf.alias("conf"), "n_evidence", "n_modules")


# ---- product and business views ----------------------------------------------------------

def archetype_votes(features: DataFrame, archetypes: dict = P.ARCHETYPES) -> DataFrame:
    """One vote per feature and archetype."""
    hits = F.array_compact(F.array(*[
        F.when(contains_any(F.col("name"), kws), F.struct(F.lit(i).alias("ord"), F.lit(a).alias("archetype")))
        for i, (a, (kws, _, _)) in enumerate(archetypes.items())]))
    return features.select("repo", "conf", F.explode(hits).alias("h")).groupBy("repo", "h.ord", "h.archetype") \
                   .agg(F.count("*").alias("votes"), F.sum("conf").alias("conf_sum"))


def archetype_vote(features: DataFrame, archetypes: dict = P.ARCHETYPES) -> DataFrame:
    """The archetype with most votes; below two votes a general one."""
    best = archetype_votes(features, archetypes).groupBy("repo").agg(
        F.max(F.struct("votes", "conf_sum", (-F.col("ord")).alias("o"), "archetype")).alias("b"))
    out = features.select("repo").distinct().join(best, "repo", "left")
    name = F.when(F.coalesce(F.col("b.votes"), F.lit(0)) >= 2, F.col("b.archetype")).otherwise(P.NO_ARCHETYPE[0])
    shown = {a: (d, f) for a, (_, d, f) in archetypes.items()} | {P.NO_ARCHETYPE[0]: P.NO_ARCHETYPE[1:]}
    table = lambda i: F.create_map(*[F.lit(x) for a, v in shown.items() for x in (a, v[i])])
    return out.select("repo", name.alias("archetype"), F.coalesce("b.votes", F.lit(0)).cast("long").alias("votes")) \
              .withColumn("display", F.element_at(table(0), F.col("archetype"))) \
              .withColumn("fragment", F.element_at(table(1), F.col("archetype")))


def _capability_rows(features: DataFrame) -> DataFrame:
    best = features.groupBy("repo").agg(F.max("conf").alias("top"))
    floor = F.when(F.col("top") >= 70, 70).otherwise(50)
    return features.join(best, "repo").filter(F.col("conf") >= floor)


def capabilities(features: DataFrame) -> DataFrame:
    """Capability labels above the threshold, ranked."""
    rows = _capability_rows(features).select("repo", "name", "conf", "feature_id")
    out = number_rows(rows, ["repo"], [F.desc("conf"), "name", "feature_id"], "rank")
    return out.select("repo", "rank", title_with_acronyms(F.col("name")).alias("capability"), "conf")


def product_summary(features: DataFrame, archetypes: dict = P.ARCHETYPES) -> DataFrame:
    """A sentence from the three leading capabilities, infrastructure and tests, 120 words at most."""
    rows = _capability_rows(features)
    count = rows.groupBy("repo").agg(F.count("*").alias("n"))
    order = [F.desc("conf"), "name", "feature_id"]
    label = title_with_acronyms(F.col("name"))
    lead = top_k(rows.select("repo", "name", "conf", "feature_id"), ["repo"], order, 3)
    joined = lambda df, out: df.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("rank", label.alias("label")))), lambda s: s["label"]), ", ").alias(out))  # three rows at most
    sure = features.filter("conf >= 70")
    infra = top_k(sure.filter(contains_any(F.col("name"), P.INFRA_WORDS)).select("repo", "name", "ord"), ["repo"], ["ord"], 2)
    tests = sure.groupBy("repo").agg(F.bool_or(contains_any(F.col("name"), P.TEST_WORDS)).alias("tests"))
    out = (archetype_vote(features, archetypes).join(count, "repo", "left").join(joined(lead, "lead"), "repo", "left")
           .join(joined(infra, "infra"), "repo", "left").join(tests, "repo", "left"))
    n = F.coalesce("n", F.lit(0))
    top = (F.when(n == 0, "no high-confidence capabilities detected").when(n <= 3, F.col("lead"))
           .otherwise(F.concat("lead", F.lit(", and "), (n - 3).cast("string"), F.lit(" more"))))
    text = F.concat_ws(" ", F.concat("display", F.lit(" is a "), "fragment", F.lit(" comprising "), n.cast("string"),
                                     F.lit(" functional capability/capabilities: "), top, F.lit(".")),
                       F.concat(F.lit("Infrastructure includes "), "infra", F.lit(".")),
                       F.when(F.col("tests"), "An automated test suite is present."))
    return out.select("repo", F.col("archetype").alias("product"), trim_to_words(text, 120).alias("summary"), n.alias("n_capabilities"))


def business_context(features: DataFrame, system_type: str = "unknown") -> DataFrame:
    """Product type by votes, user groups, and a value sentence from the three best features."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    hit = lambda words, i, kw, value: F.when(text.contains(kw), F.struct(F.lit(i).alias("kw"), F.lit(value).alias("value")))
    found = lambda words: F.array_compact(F.array(*[hit(words, i, kw, v) for i, (kw, v) in enumerate(words)]))
    votes = (features.select("repo", "ord", F.explode(found(P.PRODUCT_WORDS)).alias("h"))
             .groupBy("repo", F.col("h.value").alias("value")).agg(F.count("*").alias("votes"), F.min(F.struct("ord", "h.kw")).alias("seen")))
    product = votes.groupBy("repo").agg(F.min(F.struct((-F.col("votes")).alias("v"), "seen", "value"))["value"].alias("product_type"))
    users = (features.select("repo", F.explode(found(P.USER_WORDS)).alias("h")).groupBy("repo")
             .agg(F.array_join(F.array_sort(F.collect_set("h.value")), ", ").alias("primary_users")))  # eleven fixed values
    lead = top_k(features.select("repo", "name", "conf", "ord"), ["repo"], [F.desc("conf"), "ord"], 3)
    names = lead.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", display(F.col("name")).alias("label")))), lambda s: s["label"]).alias("lead"))
    x = F.col("lead")
    value = (F.when(F.size(x) == 1, x[0]).when(F.size(x) == 2, F.concat(x[0], F.lit(" and "), F.get(x, F.lit(1))))
             .otherwise(F.concat(x[0], F.lit(", "), F.get(x, F.lit(1)), F.lit(", and "), F.get(x, F.lit(2)))))
    plain = f"{system_type.capitalize()} Software System" if system_type not in ("", "unknown") else "Technical Software System"
    out = features.select("repo").distinct().join(product, "repo", "left").join(users, "repo", "left").join(names, "repo", "left")
    return out.select("repo", F.coalesce("product_type", F.lit(plain)).alias("product_type"),
                      F.coalesce("primary_users", F.lit("General System Users")).alias("primary_users"),
                      F.coalesce(F.concat(F.lit("Delivers "), value, F.lit(" functionality.")),
                                 F.lit("Delivers basic functional capabilities.")).alias("core_value"))


# ---- features from signals and packs -------------------------------------------------------

def _feature(df, name, description, conf, family, order="name"):
    return df.select("repo", name.alias("name"), description.alias("description"),
                     (F.lit(conf) if isinstance(conf, int) else conf).cast("int").alias("conf"), F.lit(family).alias("family"))


def _s(x):
    return F.col(x).cast("string")


def web_features(contracts: DataFrame, auth: DataFrame, middleware: DataFrame) -> DataFrame:
    """API surface per path prefix, authentication types, middleware families."""
    prefix = F.substring_index(F.regexp_replace("path", "^/+|/+$", ""), "/", 1)
    per_prefix = contracts.withColumn("prefix", prefix)
    lead = top_k(per_prefix.select("repo", "prefix", "path", "kind", "source_file", "pos"), ["repo", "prefix"],
                 ["kind", "source_file", "pos", "path"], 5)
    shown = lead.groupBy("repo", "prefix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "path"))), lambda s: s["path"]), ", ").alias("shown"))  # five rows at most
    surface = per_prefix.groupBy("repo", "prefix").agg(F.count("*").alias("n")).join(shown, ["repo", "prefix"])
    a = auth.filter("standing <> 'weak'")
    main = F.col("standing") == "dominant"
    return (_feature(surface, F.concat("prefix", F.lit("_api_surface")),
                     F.concat(F.lit("API endpoints under /"), "prefix", F.lit(" ("), _s("n"), F.lit(" routes: "), "shown", F.lit(")")), 85, "contracts")
            .unionByName(_feature(a, F.concat("auth_type", F.lit("_authentication")),
                                  F.when(main, F.concat(F.lit("Authentication using "), F.upper("auth_type"), F.lit(" mechanism.")))
                                  .otherwise(F.concat(F.lit("Secondary auth mechanism: "), F.upper("auth_type"))),
                                  F.when(main, 90).otherwise(60), "auth"))
            .unionByName(_feature(middleware, F.concat("signal", F.lit("_middleware")),
                                  F.concat(display(F.col("signal")), F.lit(" middleware detected in "), _s("n_files"), F.lit(" file(s)")), 75, "middleware")))


def _names(df, col):
    """Sorted distinct rule names of a repository: bounded by the rule table."""
    return df.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set(col)), ", ").alias("names"),
                                  F.count_distinct(col).alias("n"))


def data_features(pipelines: DataFrame, orch: DataFrame, sources: DataFrame, quality: DataFrame) -> DataFrame:
    """Pipelines, orchestrators, sources and quality checks."""
    parts = pipelines.groupBy("repo").agg(F.count("*").alias("n_parts")).join(_names(orch, "signal"), "repo", "left")
    return (_feature(parts, F.lit("data_pipeline_orchestration"),
                     F.concat(F.lit("Data pipeline with "), _s("n_parts"), F.lit(" pipeline component(s) using "), F.coalesce("names", F.lit(""))), 90, "pipelines")
            .unionByName(_feature(orch, F.concat("signal", F.lit("_integration")),
                                  F.concat(F.lit("Data processing integration with "), title(F.col("signal"))), 85, "orchestrators"))
            .unionByName(_feature(_names(sources, "signal"), F.lit("data_source_integration"),
                                  F.concat(F.lit("Data pipeline connects to "), _s("n"), F.lit(" source/sink type(s): "), "names"), 85, "sources"))
            .unionByName(_feature(_names(quality, "signal"), F.lit("data_quality_framework"),
                                  F.concat(F.lit("Data quality checks using: "), "names"), 80, "quality")))


def ml_features(stages: DataFrame, models: DataFrame) -> DataFrame:
    """Stages and architectures with confidence by file count."""
    text = F.create_map(*[F.lit(x) for pair in S.ML_STAGE_TEXT.items() for x in pair])
    pct = lambda c: F.round(F.col(c) * 100).cast("int")
    return (_feature(stages, F.col("signal"), F.concat(F.element_at(text, F.col("signal")), F.lit(". Found in "), _s("n_files"), F.lit(" file(s)")),
                     pct("confidence"), "stages")
            .unionByName(_feature(models, F.concat("signal", F.lit("_model")),
                                  F.concat(display(F.col("signal")), F.lit(" model architecture detected in "), _s("n_files"), F.lit(" file(s)")),
                                  pct("confidence"), "models")))


def mobile_features(screens: DataFrame, permissions: DataFrame, platforms: DataFrame) -> DataFrame:
    """Screens per platform, permissions, supported platforms."""
    prefix = F.substring_index("type", "_", 1)
    labels = F.create_map(*[F.lit(x) for pair in S.SCREEN_LABELS.items() for x in pair])
    kinds = screens.groupBy("repo", "type").agg(F.count("*").alias("n")).withColumn("prefix", prefix)
    perms = permissions.groupBy("repo").agg(F.count("*").alias("n"))
    return (_feature(kinds, F.concat("prefix", F.lit("_screen_navigation")),
                     F.concat(F.element_at(labels, F.col("prefix")), F.lit(" app with "), _s("n"), F.lit(" screen(s)/page(s)")),
                     F.least(F.lit(90), 70 + 5 * F.col("n")), "screens")
            .unionByName(_feature(perms, F.lit("device_permission_management"),
                                  F.concat(F.lit("App requests "), _s("n"), F.lit(" device permission(s)")), 90, "permissions"))
            .unionByName(_feature(_names(platforms, "platform"), F.lit("cross_platform_mobile_support"),
                                  F.concat(F.lit("App targets "), _s("n"), F.lit(" platform(s): "), "names"), 95, "platforms")))


def signal_features(parts: dict) -> DataFrame:
    """Pack features of all families; ``parts`` maps a pack to its features."""
    tagged = [df.withColumn("pack", F.lit(pack)) for pack, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def merge_pack_results(scores: DataFrame, features: DataFrame, signals: DataFrame) -> tuple:
    """What the activated packs give: features, ``pack.key`` signals and one hint per section.

    Packs with notes only give their notes and emphasis as signals.
    """
    active = scores.select("repo", "pack", "score")
    feats = features.join(active, ["repo", "pack"]).select("repo", "pack", "name", "description", "conf", "family")
    keyed = signals.join(active, ["repo", "pack"]).select("repo", F.concat("pack", F.lit("."), "family").alias("key"), F.col("signal").alias("value"))
    notes = [(p, "nfr_emphasis", v) for p, vs in P.PACK_EMPHASIS.items() for v in vs] \
        + [(p, "section_notes." + s, t) for p in P.PACK_EMPHASIS for s, t in P.PACK_HINTS[p].items()]
    spark = scores.sparkSession
    note_dim = F.broadcast(fixed_rows(spark, notes, "pack string, key string, value string"))  # fixed notes
    keyed = keyed.unionByName(active.join(note_dim, "pack").select("repo", F.concat("pack", F.lit("."), "key").alias("key"), "value")).distinct()
    hints = [(p, i, s, t) for i, (p, hs) in enumerate(P.PACK_HINTS.items()) for s, t in hs.items()]
    hint_dim = F.broadcast(fixed_rows(spark, hints, "pack string, pack_no int, section string, hint string"))
    merged = active.join(hint_dim, "pack").groupBy("repo", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "pack_no", "hint"))), lambda x: x["hint"]), " ").alias("hint"))  # one row per pack
    return feats, keyed, merged
