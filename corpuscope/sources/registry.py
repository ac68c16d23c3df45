"""Configuration files -> dimension tables. The tables are small and checked to be so."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..rules.languages import REGISTRY, Registry
from ..rules.packs import ARCHETYPES, PACKS
from ..session import fixed_rows, small_rows

LANGUAGE = T.StructType([
    T.StructField("extensions", T.ArrayType(T.StringType())), T.StructField("role", T.StringType()),
    T.StructField("entry_points", T.ArrayType(T.StringType())),
    T.StructField("build_files", T.ArrayType(T.StringType())), T.StructField("notes", T.StringType())])
LANGUAGE_FILE = T.StructType([
    T.StructField("ignore_dirs", T.ArrayType(T.StringType())),
    T.StructField("languages", T.MapType(T.StringType(), LANGUAGE)),
    T.StructField("inferred", T.MapType(T.StringType(), LANGUAGE))])
ARCHETYPE_FILE = T.StructType([T.StructField("archetypes", T.MapType(T.StringType(), T.StructType([
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("display", T.StringType()),
    T.StructField("fragment", T.StringType())])))])
PACK_FILE = T.StructType([T.StructField("packs", T.MapType(T.StringType(), T.StructType([
    T.StructField("evidence_flags", T.ArrayType(T.StringType())),
    T.StructField("dependency_keywords", T.ArrayType(T.StringType())),
    T.StructField("file_patterns", T.ArrayType(T.StringType())),
    T.StructField("confidence_threshold", T.DoubleType())])))])


def _json(spark, path, schema):
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def language_table(spark: SparkSession, path: str) -> DataFrame:
    """Languages of a registry file, curated tier first; names starting with ``_`` are notes."""
    raw = _json(spark, path, LANGUAGE_FILE)
    tiers = [raw.select(F.lit(tier).alias("tier"), F.posexplode(tier).alias("pos", "language", "def"))
             for tier in ("languages", "inferred")]
    out = tiers[0].unionByName(tiers[1]).filter(~F.col("language").startswith("_"))
    tier = F.when(F.col("tier") == "languages", "curated").otherwise("inferred")
    return out.select("language", F.col("def.role").alias("role"), tier.alias("tier"), "pos",
                      "def.extensions", "def.entry_points", "def.build_files")


def load_language_registry(spark: SparkSession, path: str) -> DataFrame:
    """A3: one row per extension; curated languages win over inferred ones."""
    rows = language_table(spark, path).withColumn("ext", F.explode("extensions")) \
        .withColumn("ext", F.lower("ext"))
    w = W.partitionBy("ext").orderBy("tier", "pos")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("ext", "language", "role", "tier")


def registry_from(spark: SparkSession, path: str) -> Registry:
    """A registry object built from a file; every table is read through the size check."""
    ext = tuple(tuple(r) for r in small_rows(load_language_registry(spark, path).orderBy("ext")))
    table = language_table(spark, path)
    names = lambda col: tuple(r[0] for r in small_rows(table.select(F.explode(col)).distinct().orderBy("col")))
    langs = tuple(tuple(r) for r in small_rows(table.select("language", "role", "tier").orderBy("language")))
    lower = lambda col: tuple(dict.fromkeys(n.split("/")[-1].lower() for n in names(col)))
    return Registry(ext, lower("entry_points"), lower("build_files"), langs)


def lang_ext(spark: SparkSession, registry: Registry = REGISTRY) -> DataFrame:
    return fixed_rows(spark, list(registry.lang_ext), "ext string, language string, role string, tier string")


def list_languages(spark: SparkSession, registry: Registry = REGISTRY) -> DataFrame:
    """Distinct language names of both tiers."""
    rows = fixed_rows(spark, list(registry.languages), "language string, role string, tier string")
    tier = lambda t: rows.filter(F.col("tier") == t).select("language")
    return tier("curated").union(tier("inferred")).filter(~F.col("language").startswith("_")).distinct()


def load_archetypes(spark: SparkSession, path: str) -> DataFrame:
    """A4: one row per archetype keyword, in file order."""
    raw = _json(spark, path, ARCHETYPE_FILE).select(F.posexplode("archetypes").alias("ord", "archetype", "def"))
    return raw.select("ord", "archetype", F.explode("def.keywords").alias("keyword"),
                      F.col("def.display").alias("display"), F.col("def.fragment").alias("fragment"))


def archetypes_from(df: DataFrame) -> dict:
    out = {}
    for r in sorted(small_rows(df), key=lambda r: r.ord):
        out.setdefault(r.archetype, ([], r.display, r.fragment))[0].append(r.keyword)
    return out


def load_pack_rules(spark: SparkSession, path: str) -> DataFrame:
    """A5: one row per detection signal of a pack."""
    raw = _json(spark, path, PACK_FILE).select(F.explode("packs").alias("pack", "def"))
    dims = [raw.select("pack", F.lit(dim).alias("dimension"), F.explode(f"def.{col}").alias("signal"),
                       F.coalesce("def.confidence_threshold", F.lit(0.6)).alias("threshold"))
            for dim, col in (("flag", "evidence_flags"), ("dependency", "dependency_keywords"),
                             ("glob", "file_patterns"))]
    return dims[0].unionByName(dims[1]).unionByName(dims[2])


def pack_rows(packs: dict = PACKS):
    out = []
    for pack, (threshold, flags, deps, globs) in packs.items():
        out += [(pack, "flag", s, threshold) for s in flags]
        out += [(pack, "dependency", s, threshold) for s in deps]
        out += [(pack, "glob", s, threshold) for s in globs]
    return out


def packs_from(df: DataFrame) -> dict:
    out = {}
    slot = {"flag": 1, "dependency": 2, "glob": 3}
    for r in small_rows(df):
        out.setdefault(r.pack, (r.threshold, [], [], []))[slot[r.dimension]].append(r.signal)
    return out


def archetype_rows(archetypes: dict = ARCHETYPES):
    return [(i, name, kw, d, f) for i, (name, (kws, d, f)) in enumerate(archetypes.items()) for kw in kws]
