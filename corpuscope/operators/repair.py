"""Repair of documents: vague phrases, ungrounded claims, missing sections, traceability."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_any, display
from ..rules import documents as D
from ..session import hold, release
from . import quality as Q
from .chunks import bound
from .names import salted_join


def clear_phrases(text: Column, vague: Column) -> Column:
    """Precise phrases for vague ones in the texts marked ``vague``; the others are left alone."""
    clear = text
    for phrase, precise in D.CLARITY.items():
        clear = F.regexp_replace(clear, Q.quoted(phrase), precise)
    return F.when(vague, clear).otherwise(text)


def repair_clarity(docs: DataFrame) -> DataFrame:
    """Precise phrases for vague ones, and how many different phrases were replaced.

    Phrases are replaced in order, so the count looks at the text each phrase meets.
    """
    text, log = F.col("text"), F.lit(0)
    out = docs
    for i, (phrase, precise) in enumerate(D.CLARITY.items()):
        log = log + F.when(text.rlike(Q.quoted(phrase)), 1).otherwise(0)
        text = F.regexp_replace(text, Q.quoted(phrase), precise)
    return out.withColumn("n_replaced", log).withColumn("text", text)


def ground_text(docs: DataFrame) -> DataFrame:
    """Apply the replacements of every rule whose terms are in ``bad``, rule by rule.

    One projection per rule: as one expression, each rule would double the one before it.
    """
    for terms, changes in D.GROUNDING_REPAIR:
        changed = F.col("text")
        for regex, replacement in changes:
            changed = F.regexp_replace(changed, regex, replacement)
        hit = F.arrays_overlap("bad", F.array(*[F.lit(t) for t in terms]))
        docs = docs.withColumn("text", F.when(hit, changed).otherwise(F.col("text")))
    return docs


def structure_text(text: Column) -> Column:
    """The text with a stub for every missing heading; no stub holds another heading."""
    stubs = [F.when(text.contains(h), "").otherwise(f"\n{h}\n*{h[3:]} — content pending.*\n") for h in D.STUB_HEADINGS]
    return F.concat(text, *stubs)


def tidy(text: Column) -> Column:
    """No runs of blank lines, and no white space at the ends.

    The end of the regex may also stand before a last line separator, so it is left to texts with one.
    """
    fewer = F.when(text.contains("\n\n\n"), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)
    odd = text.endswith("\u0085") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(odd, F.regexp_replace(fewer, r"^\s+|\s+$", "")).otherwise(F.btrim(fewer, F.lit(" \t\n\x0b\f\r")))


def _with_bad_terms(docs: DataFrame, ev: DataFrame) -> DataFrame:
    """Documents with the ungrounded terms they mention, and whether they hold a vague phrase. Flags join on the repository."""
    told = docs.withColumn("lowered", F.lower("text"))  # once, it is dear where a text is not ASCII
    told = told.select(*docs.columns, Q.mentions(F.col("text"), F.col("lowered")).alias("mentioned"), contains_any(F.col("lowered"), D.CLARITY).alias("vague"))
    out = salted_join(told, Q._flags(ev), ["repo"], how="left")
    bad = F.when(F.col("known"), Q.ungrounded(F.col("mentioned"))).otherwise(F.expr("cast(array() as array<string>)"))
    return out.withColumn("bad", bad).select(*docs.columns, "bad", "vague")


def repair_grounding(docs: DataFrame, ev: DataFrame) -> DataFrame:
    """I16: neutral wording for technology claims without evidence."""
    return ground_text(_with_bad_terms(docs, ev)).drop("bad", "vague")


def repair_structure(docs: DataFrame) -> DataFrame:
    """Stubs for missing sections, no runs of blank lines, trimmed."""
    return docs.withColumn("text", tidy(structure_text(F.col("text"))))


def _feature_line(shown: Column, ids: Column) -> Column:
    return F.concat(F.lit("| "), shown, F.lit(" | "), F.when(ids == "", "—").otherwise(ids), F.lit(" | — |"))


def _id_rows(frs: DataFrame) -> DataFrame:
    """(repo, req_id, ord, line) of the rows for ids on their own, behind those of the features."""
    return frs.select("repo", "req_id", (F.col("ord").cast("long") + 1_000_000_000_000).alias("ord"), F.concat(
        F.lit("| "), display(F.col("linked_feature")), F.lit(" | "), "req_id", F.lit(" | _(see FR section)_ |")).alias("line"))


def _listed_ids(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(ids)), lambda s: s["req_id"]), ", ")  # three per feature at most


def _own_appendix(refs: DataFrame, named: DataFrame, linked: DataFrame, frs: DataFrame) -> DataFrame:
    """The appendix of documents whose key is theirs alone.

    Every line is made once for its repository, and a document keeps the lines that its own names
    and ids ask for, so rows of documents and features are neither shuffled nor grouped.
    """
    names = named.join(linked, ["repo", "name"], "left").withColumn("id", F.when(F.col("req_id").isNotNull(), F.struct("fr_ord", "req_id")))
    lines = names.groupBy("repo", "name", "shown", "ord").agg(_listed_ids(F.col("id")).alias("ids")).select(
        "repo", "name", "shown", F.col("ord").cast("long").alias("ord"), _feature_line(F.col("shown"), F.col("ids")).alias("line"))
    absent = lambda f: ~(F.array_contains("names", f["name"]) | F.array_contains("names", f["shown"]))
    by_name = salted_join(refs.drop("id_forms"), lines.withColumn("f", F.struct("name", "shown")).drop("name", "shown"), ["repo"]) \
        .filter(absent(F.col("f"))).select("doc_key", "ord", "line")
    owners = linked.join(named.select("repo", "name", "shown").distinct(), ["repo", "name"]).groupBy("repo", "req_id").agg(
        F.collect_set(F.struct("name", "shown")).alias("owners"))  # an id is of one feature
    ids = _id_rows(frs.filter("req_id is not null")).join(owners, ["repo", "req_id"], "left")
    by_id = salted_join(refs, ids, ["repo"]).filter(~F.array_contains("id_forms", F.col("req_id"))) \
        .filter(~F.coalesce(F.exists("owners", absent), F.lit(False))).select("doc_key", "ord", "line")
    return by_name.unionByName(by_id)


def _shared_appendix(refs: DataFrame, features: DataFrame, linked: DataFrame, frs: DataFrame) -> DataFrame:
    """The appendix of keys that several documents have, or none: one list for a key, of what all of them lack."""
    lacking = Q.lacking_features(refs, features)
    with_ids = salted_join(lacking, linked, ["repo", "name"], how="left")
    rows = with_ids.groupBy("doc_key", "name", "shown", "ord").agg(
        _listed_ids(F.when(F.col("req_id").isNotNull(), F.struct("fr_ord", "req_id"))).alias("ids"))
    named = rows.select("doc_key", F.col("ord").cast("long").alias("ord"), _feature_line(F.col("shown"), F.col("ids")).alias("line"))
    absent = salted_join(Q.lacking_ids(refs, frs), _id_rows(frs), ["repo", "req_id"])
    listed = with_ids.filter("req_id is not null").select("doc_key", "req_id").distinct()
    alone = absent.join(listed, ["doc_key", "req_id"], "left_anti").select("doc_key", "ord", "line")
    return named.unionByName(alone)


def traceability_appendix(docs: DataFrame, features: DataFrame, frs: DataFrame) -> DataFrame:
    """Appendix rows (doc_key, ord, line) for names and ids a document lacks.

    Rows instead of a longer text: their number depends on the features of the repository.
    A missing id is listed on its own unless the row of its missing feature lists it already.
    """
    refs = Q.references(docs, features)
    linked = frs.select("repo", F.col("linked_feature").alias("name"), "req_id", F.col("ord").alias("fr_ord"))
    single = hold(refs.groupBy("doc_key").agg(F.count("*").alias("n")).filter("n = 1 and doc_key is not null").select("doc_key"))
    own = _own_appendix(refs.join(single, "doc_key", "left_semi"), Q.named_features(features), linked, frs)
    return own.unionByName(_shared_appendix(refs.join(single, "doc_key", "left_anti"), features, linked, frs))


# ---- the revision log --------------------------------------------------------------------

EDIT = "array<struct<step:int,kind:string,n:int,at:int,old:string,new:string>>"


def _steps() -> list[tuple]:
    """(kind, condition or None, regex, replacement) of one repair pass, in order; a condition is a list of terms."""
    out = [("clarity", None, Q.quoted(p), new) for p, new in D.CLARITY.items()]
    out += [("structure", h, r"\z", f"\n{h}\n*{h[3:]} — content pending.*\n") for h in D.STUB_HEADINGS]
    out += [("grounding", terms, regex, new) for terms, changes in D.GROUNDING_REPAIR for regex, new in changes]
    return [*out, ("tidy", None, r"\n{3,}", "\n\n"), ("tidy", None, r"^\s+", ""), ("tidy", None, r"\s+\z", "")]


def _edits(text: Column, step: Column) -> Column:
    """The replacements of one step: number, offset in the text the step meets, old and new text."""
    edit = lambda n, at, old: F.struct(step["step"].alias("step"), step["kind"].alias("kind"), n.cast("int").alias("n"),
                                       at.cast("int").alias("at"), old.alias("old"), step["new"].alias("new"))
    length = lambda parts, k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
    olds = F.regexp_extract_all(text, F.concat(F.lit("("), step["regex"], F.lit(")")), F.lit(1))
    replaced = bound(F.struct(olds.alias("o"), F.split(text, step["regex"], -1).alias("b")), lambda s: F.transform(
        s["o"], lambda old, i: edit(i + 1, length(s["b"], i + 1) + length(s["o"], i) + 1, old)))
    return F.when(step["kind"] == "structure", F.array(edit(F.lit(1), F.length(text) + 1, F.lit("")))).otherwise(replaced)


def logged_pass(docs: DataFrame, ev: DataFrame) -> DataFrame:
    """One repair pass over documents, with the edits that make its text.

    The steps are a table in the plan and each document folds over it; a step logs only what it
    replaces, so most steps of most documents leave nothing.
    """
    rows = [F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), F.lit(condition if kind == "structure" else "").alias("heading"),
                     F.array(*[F.lit(t) for t in (condition if kind == "grounding" else [])]).cast("array<string>").alias("terms"),
                     F.lit(regex).alias("regex"), F.lit(new).alias("new")) for n, (kind, condition, regex, new) in enumerate(_steps(), 1)]
    start = F.struct(F.col("text").alias("text"), F.array().cast(EDIT).alias("edits"))

    def apply(state: Column, step: Column) -> Column:
        text = state["text"]
        hit = F.when(step["kind"] == "structure", ~F.contains(text, step["heading"])).otherwise(
            ((F.size(step["terms"]) == 0) | F.arrays_overlap("bad", step["terms"])) & F.rlike(text, step["regex"]))
        changed = F.when(step["kind"] == "structure", F.concat(text, step["new"])).otherwise(F.regexp_replace(text, step["regex"], step["new"]))
        return F.when(hit, F.struct(changed.alias("text"), F.concat(state["edits"], _edits(text, step)).alias("edits"))).otherwise(state)

    out = _with_bad_terms(docs, ev).withColumn("done", F.aggregate(F.array(*rows), start, apply))
    return out.select("doc_key", "repo", F.col("done.text").alias("text"), F.col("done.edits").alias("edits"))


def revision_log(docs: DataFrame, ev: DataFrame) -> DataFrame:
    """(doc_key, step, kind, n, at, old, new): one row for each replacement of a repair pass.

    ``at`` counts from 1 in the text as the step finds it; ``replay`` makes the final text of it.
    """
    return logged_pass(docs, ev).select("doc_key", F.explode("edits").alias("e")).select("doc_key", "e.*")


def replay(docs: DataFrame, log: DataFrame) -> DataFrame:
    """The documents with a revision log applied to their texts; only logged documents meet the log.

    Steps are folded in order, and in a step the replacements from the last to the first, so that
    the offsets of those before it still hold.
    """
    per_doc = log.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("step", (-F.col("n")).alias("last"), "at", F.length("old").alias("gone"), "new"))).alias("edits"))
    text = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<step:int,last:int,at:int,gone:int,new:string>>")), F.col("text"), lambda t, e: F.concat(
        F.substr(t, F.lit(1), e["at"] - 1), e["new"], F.substr(t, e["at"] + e["gone"])))
    return docs.join(per_doc, "doc_key", "left").withColumn("text", text).drop("edits")


def repair_pass(docs: DataFrame, scores: DataFrame, ev: DataFrame, note: bool = False) -> DataFrame:
    """One pass: documents that need a revision are repaired, the others stay as they are.

    With ``note`` the rows also say whether the text has ``changed``.
    """
    marked = docs.join(scores.select("doc_key", "needs_revision"), "doc_key")
    fixed = _with_bad_terms(marked, ev).withColumn("old", F.col("text"))
    fixed = ground_text(fixed.withColumn("text", structure_text(clear_phrases(F.col("text"), F.col("vague")))))
    text = F.when(F.col("needs_revision"), tidy(F.col("text"))).otherwise(F.col("old"))
    out = fixed.select("doc_key", "repo", text.alias("text"), (F.col("iterations") + F.col("needs_revision").cast("int")).alias("iterations"), "old")
    return out.withColumn("changed", ~F.col("text").eqNullSafe(F.col("old"))).drop("old") if note else out.drop("old")


def repair_loop(docs: DataFrame, features: DataFrame, frs: DataFrame, ev: DataFrame, passes: int = 2) -> DataFrame:
    """Score, repair where needed, score again; two passes, held in between.

    A document whose text a pass leaves as it was keeps its scores, so only the texts that a pass
    changes are read again, and the unrolled passes give what a loop with an early stop gives.
    """
    state = docs.select("doc_key", "repo", "text").withColumn("iterations", F.lit(0))
    first = scores = hold(Q.score_document(state, features, frs, ev))
    for _ in range(passes):
        before, known = state, scores
        state = hold(repair_pass(state, scores, ev, note=True))
        again = Q.score_document(state.filter("changed").select("doc_key", "repo", "text"), features, frs, ev)
        kept = known.join(state.filter("changed").select("doc_key").distinct(), "doc_key", "left_anti")
        scores = hold(kept.unionByName(again))
        release(before, *([known] if known is not first else []))
        state = state.drop("changed")
    before = first.select("doc_key", F.col("score").alias("first_score"))
    return state.join(scores.drop("repo"), "doc_key").join(before, "doc_key")
