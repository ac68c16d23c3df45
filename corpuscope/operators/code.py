"""Endpoints, RPCs and entities from source text. One row per file until the finds are known."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import stem
from ..functions.text import lit_array
from ..rules import signals as S
from .signals import matches


def nearest_following(lines: Column, start: Column, regex: str, reach: int = 5) -> Column:
    """first match of ``regex`` in ``reach`` lines from ``start`` (0-based), else null."""
    near = F.transform(F.slice(lines, start + 1, reach), lambda x: F.regexp_extract(x, regex, 1))
    return F.get(F.filter(near, lambda x: x != ""), F.lit(0))


def spring_endpoints(df: DataFrame) -> DataFrame:
    """(repo, method, path, handler, source_file, line, kind) of controller mappings."""
    content = F.col("content")
    kept = df.filter(F.col("ext").isin(".kt", ".java") & ~F.lower("path").contains("/test/")
                     & content.rlike(S.CONTROLLER_CLASS))
    base = F.regexp_replace(F.regexp_extract("content", S.CLASS_MAPPING, 1), "/+$", "")
    rows = kept.select("repo", F.col("path").alias("source_file"), base.alias("base"),
                       F.regexp_extract("content", S.CONTROLLER_CLASS, 1).alias("controller"),
                       F.split("content", "\n").alias("lines"))
    lines = F.col("lines")
    hits = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("text"))),
                    lambda s: s["text"].rlike(S.METHOD_MAPPING) | s["text"].rlike(S.REQUEST_MAPPING))
    rows = rows.withColumn("hit", F.explode(hits)).withColumn(
        "fn", nearest_following(lines, F.col("hit.line"), S.FUNCTION_NAME))
    text = F.col("hit.text")

    def one(kind, regex, empty_is_base):
        sub = F.regexp_extract(text, regex, 2)
        full = F.replace(F.concat("base", F.lit("/"), sub), F.lit("//"), F.lit("/"))
        if empty_is_base:
            full = F.when(sub != "", full).when(F.col("base") != "", F.col("base")).otherwise("/")
        return F.when(text.rlike(regex), F.struct(F.lit(kind).alias("kind"), F.upper(F.regexp_extract(text, regex, 1)).alias("method"), full.alias("path")))

    pair = F.array_compact(F.array(one(0, S.METHOD_MAPPING, True), one(1, S.REQUEST_MAPPING, False)))
    handler = F.when(F.col("fn").isNotNull(), F.concat("controller", F.lit("."), "fn")).otherwise(F.col("controller"))
    return rows.select("repo", "source_file", (F.col("hit.line") + 1).alias("line"), handler.alias("handler"),
                       F.explode(pair).alias("e")) \
               .select("repo", "e.method", "e.path", "handler", "source_file", "line", "e.kind")


def proto_rpcs(df: DataFrame) -> DataFrame:
    """(repo, service, rpc, request, response, source_file, pos)."""
    kept = df.filter((F.col("ext") == ".proto") & F.col("content").contains("service"))
    services = matches(F.col("content"), S.PROTO_SERVICE, (1, 2), ("service", "body"))
    rows = kept.select("repo", F.col("path").alias("source_file"), F.posexplode(services).alias("at", "s"))
    rpcs = matches(F.col("s.body"), S.PROTO_RPC, (1, 2, 3), ("rpc", "request", "response"))
    return rows.select("repo", "source_file", "at", F.col("s.service").alias("service"), F.posexplode(rpcs).alias("pos", "r")) \
               .select("repo", "service", "r.rpc", "r.request", "r.response", "source_file",
                       F.struct("at", F.col("pos").alias("rpc")).alias("pos"))


ENTITY = "array<struct<name:string,fields:array<string>>>"


def _entity_rows(kept, table, found, kind, order):
    rows = kept.select("repo", F.col("path").alias("source_file"), table.alias("table_name"), F.posexplode(found).alias("pos", "e"))
    return rows.select("repo", "e.name", "source_file", "table_name", F.col("e.fields").alias("fields"),
                       F.lit(kind).alias("entity_type"), F.lit(order).alias("kind"), "pos")


def _jvm_files(df):
    """Kotlin and Java sources that are not tests."""
    p = F.lower("path")
    return df.filter(F.col("ext").isin(".kt", ".java") & ~p.contains("/test/") & ~F.lower(stem(F.col("path"))).contains("test"))


def _table_name():
    name = F.regexp_extract("content", S.TABLE_NAME, 1)
    return F.when(name != "", name)


def jpa_entities(df: DataFrame) -> DataFrame:
    """C4"""
    kotlin = F.regexp_extract_all("content", F.lit(S.KOTLIN_FIELD), F.lit(1))
    java = F.regexp_extract_all("content", F.lit(S.JAVA_FIELD), F.lit(1))
    fields = F.filter(F.when(F.size(kotlin) > 0, kotlin).otherwise(java), lambda f: ~f.isin(S.FIELD_NOISE))
    found = F.transform(F.regexp_extract_all("content", F.lit(S.JPA_ENTITY), F.lit(1)),
                        lambda n: F.struct(n.alias("name"), F.col("all_fields").alias("fields")))
    kept = _jvm_files(df).filter(F.col("content").contains("@Entity")).withColumn("all_fields", fields)
    return _entity_rows(kept, _table_name(), found, "jpa_entity", 0)


def kotlin_data_classes(df: DataFrame) -> DataFrame:
    """Data classes with at least two fields."""
    found = F.filter(F.transform(
        matches(F.col("content"), S.KOTLIN_DATA_CLASS, (1, 2), ("name", "body")),
        lambda m: F.struct(m["name"].alias("name"), F.regexp_extract_all(m["body"], F.lit(S.KOTLIN_FIELD), F.lit(1)).alias("fields"))),
        lambda e: F.size(e["fields"]) >= 2)
    return _entity_rows(_jvm_files(df).filter(F.col("content").contains("data")), _table_name(), found, "data_class", 1)


def proto_messages(df: DataFrame) -> DataFrame:
    """C6"""
    found = F.transform(matches(F.col("content"), S.PROTO_MESSAGE, (1, 2), ("name", "body")),
                        lambda m: F.struct(m["name"].alias("name"), F.regexp_extract_all(m["body"], F.lit(S.PROTO_FIELD), F.lit(1)).alias("fields")))
    kept = df.filter((F.col("ext") == ".proto") & F.col("content").contains("message"))
    return _entity_rows(kept, F.lit(None).cast("string"), found, "proto_message", 2)


def entities(df: DataFrame) -> DataFrame:
    """C4-C6 with F2: the first entity of every name. Protobuf messages come after classes."""
    rows = jpa_entities(df).unionByName(kotlin_data_classes(df)).unionByName(proto_messages(df))
    first = F.struct((F.col("kind") == 2).alias("proto"), "source_file", "kind", "pos")
    payload = F.struct("source_file", "table_name", "fields", "entity_type")
    return rows.groupBy("repo", "name").agg(F.min_by(payload, first).alias("e")).select("repo", "name", "e.*")
