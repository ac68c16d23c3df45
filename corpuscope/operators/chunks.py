"""Chunking, snippets and the other operators that look at pieces of a file."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_any
from ..rules import signals as S
from ..session import hold
from .classify import business_path
from .numbering import top_k


def _spans(lines: Column, limit: int) -> Column:
    """(first, lines) of the chunks: whole lines until ``limit`` characters are reached.

    The fold carries three numbers and the list of spans, never text.
    """
    zero = F.struct(F.lit(0).alias("line"), F.lit(1).alias("first"), F.lit(0).alias("held"),
                    F.expr("cast(array() as array<struct<first:int,lines:int>>)").alias("spans"))

    def span(acc, end):
        return F.array_append(acc["spans"], F.struct(acc["first"].alias("first"), (end - acc["first"] + 1).alias("lines")))

    def step(acc, line):
        held = acc["held"] + F.length(line)
        full = held >= limit
        at = acc["line"] + 1
        return F.struct(at.alias("line"), F.when(full, at + 1).otherwise(acc["first"]).alias("first"),
                        F.when(full, 0).otherwise(held).alias("held"),
                        F.when(full, span(acc, at)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(lines, zero, step, lambda acc: F.when(acc["held"] > 0, span(acc, acc["line"])).otherwise(acc["spans"]))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A lambda computes every expression in its body again for each element; what it takes from
    outside must be a variable, and here the element of a one-element array is one.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunk_array(content: Column, limit: int = S.CHUNK_CHARS) -> Column:
    """C1 as a column: the texts of the chunks, in order. Joined, they give the content back."""
    return bound(F.split(content, r"(?<=\n)"), lambda lines: F.transform(
        _spans(lines, limit), lambda s: F.array_join(F.slice(lines, s["first"], s["lines"]), "")))


def chunk_count(content: Column, limit: int = S.CHUNK_CHARS) -> Column:
    """How many chunks C1 makes of a content, without making them."""
    return F.size(_spans(F.split(content, r"(?<=\n)"), limit))


def chunk_lines(classified: DataFrame, limit: int = S.CHUNK_CHARS) -> DataFrame:
    """(repo, path, category, chunk_no, chunk_id, content). Needs no shuffle."""
    rows = classified.select("repo", "path", "category",
                             F.posexplode(chunk_array(F.col("content"), limit)).alias("chunk_no", "content"))
    chunk_id = F.concat("path", F.lit("_"), F.col("chunk_no").cast("string"), F.lit("_"),
                        F.substring(F.md5("content"), 1, 8))
    return rows.select("repo", "path", "category", "chunk_no", chunk_id.alias("chunk_id"), "content")


def snippet_of(df: DataFrame, limit: int = 800) -> DataFrame:
    """The start of every file, trimmed; empty ones are dropped."""
    text = F.regexp_replace(F.substring("content", 1, limit), r"^\s+|\s+$", "")
    return df.select("repo", "path", "ext", text.alias("snippet")).filter(F.col("snippet") != "")


def key_snippets(chunks: DataFrame) -> DataFrame:
    """At most ten snippets per repository, from business logic, entry points and models.

    Pass one fills up to 6 places, pass two up to 8, pass three up to 10, one snippet per
    file. A pass can need at most 10 files, so each is cut to 10 per repository and only
    those few rows meet in the last window.
    """
    lower = F.lower("path")
    start = F.trim(F.replace(F.substring("content", 1, 600), F.lit("\n"), F.lit(" ")))
    start = F.regexp_replace(start, r"^\s+|\s+$", "")
    heads = chunks.select(
        "repo", "path", "chunk_no", start.alias("content"), business_path(F.col("path")).alias("p1"),
        (F.col("category").isin("route", "entry_point") | contains_any(lower, S.SNIPPET_ENTRY_NAMES)).alias("p2"),
        contains_any(lower, S.SNIPPET_MODEL_DIRS).alias("p3")).filter(
            (F.col("content") != "") & (F.col("p1") | F.col("p2") | F.col("p3")))
    # the first non-empty chunk of a file stands for it in every pass
    files = hold(heads.groupBy("repo", "path").agg(
        F.min_by("content", "chunk_no").alias("content"),
        *[F.bool_or(p).alias(p) for p in ("p1", "p2", "p3")]))
    chosen = top_k(files.filter("p1"), ["repo"], ["path"], 6).select("repo", "path", "content", F.lit(1).alias("pass"))
    for number, total in ((2, 8), (3, 10)):
        taken = chosen.groupBy("repo").agg(F.count("*").alias("taken"))
        rest = files.filter(f"p{number}").join(chosen.select("repo", "path"), ["repo", "path"], "left_anti")
        ranked = top_k(rest, ["repo"], ["path"], 10).join(taken, "repo", "left")
        picked = ranked.filter(F.col("rank") <= total - F.coalesce("taken", F.lit(0)))
        chosen = chosen.unionByName(picked.select("repo", "path", "content", F.lit(number).alias("pass")))
    reason = F.element_at(F.create_map(F.lit(1), F.lit("business_logic"), F.lit(2), F.lit("entry_point"),
                                       F.lit(3), F.lit("data_model")), F.col("pass"))
    return chosen.select("repo", "path", reason.alias("reason"), "content")


def model_candidate_files(df: DataFrame, limit: int = 15, prefix: int | None = None) -> DataFrame:
    """Files that look like data models, the most promising ``limit`` per repository.

    The whole content is looked at unless a ``prefix`` of so many characters is asked for.
    """
    lower = F.lower("path")
    head = F.col("content") if prefix is None else F.substring("content", 1, prefix)
    name = F.substring_index("path", "/", -1)
    looks = contains_any(head, S.MODEL_WORDS) | name.contains("message ") | contains_any(F.lower(head), S.MODEL_WORDS_LOWER)
    priority = (F.when(lower.contains("model") | lower.contains("entity"), 0)
                .when(lower.contains("schema") | lower.contains("dto"), 1).otherwise(2))
    kept = df.filter(F.col("ext").isin(S.MODEL_EXTS) & ~contains_any(lower, S.MODEL_PATH_SKIP))
    return top_k(kept.filter(looks).select("repo", "path", priority.alias("priority")),
                 ["repo"], ["priority", "path"], limit)


def keyword_files(df: DataFrame, families=S.KEYWORD_FEATURES) -> DataFrame:
    """(repo, feature, path) where the path or the content holds a keyword of the family."""
    lower, text = F.lower("path"), F.lower("content")
    hits = F.array_compact(F.array(*[
        F.when(contains_any(lower, kws) | contains_any(text, kws), F.lit(name)) for name, kws in families]))
    return df.select("repo", "path", F.explode(hits).alias("feature"))


def keyword_features(df: DataFrame, families=S.KEYWORD_FEATURES) -> DataFrame:
    """Features with confidence min(1, 0.2 per file)."""
    return (keyword_files(df, families).groupBy("repo", "feature").agg(F.count("*").alias("n_files"))
            .withColumn("confidence", F.least(F.lit(100), F.col("n_files") * 20) / 100))


def coarse_modules(role_rows: DataFrame) -> DataFrame:
    """Names of the areas a repository has at all (at most four per repository)."""
    has = lambda role, text: F.when(F.bool_or(F.col("role") == role), text)
    areas = F.array_compact(F.array(has("frontend", "Frontend UI"), has("backend", "Backend Services"),
                                    has("config", "Configuration Management"), has("docs", "Documentation")))
    return role_rows.groupBy("repo").agg(areas.alias("modules"))


def doc_gaps(df: DataFrame, role_rows: DataFrame) -> DataFrame:
    """Missing README, nothing but a README, no tests (at most three per repository)."""
    readme = df.groupBy("repo").agg(F.bool_or((F.lower("path") == "readme.md") & (F.length("content") > 0)).alias("readme"))
    roles = role_rows.groupBy("repo").agg(
        F.bool_or(F.col("role") == "docs").alias("docs"),
        F.bool_or(F.col("role").isin("frontend", "backend") & F.lower("path").contains("test")).alias("tests"))
    gaps = F.array_compact(F.array(
        F.when(~F.col("readme"), "Missing or empty README.md"),
        F.when(~F.col("docs") & F.col("readme"), "Minimal documentation (only README found)"),
        F.when(~F.col("tests"), "No obvious test files found")))
    return readme.join(roles, "repo").select("repo", gaps.alias("gaps"))
