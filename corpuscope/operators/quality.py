"""Nine quality scores of documents.

A document is one row ``(doc_key, repo, text)``. ``measure`` reads every text once and leaves
integers, ids and the names found in it; only those meet the features, requirements and evidence
of the repository, by salted equi joins, so a repository may hold most of the documents. A null
text is the empty text. Scores are kept in ten-thousandths, rounded half up with integer
arithmetic.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import display, word_count
from ..rules import documents as D
from ..session import hold
from .chunks import bound
from .names import salted_join, with_names

DIMENSIONS = ["completeness", "traceability", "phantom_ids", "clarity", "testability", "nfr_specificity",
              "stakeholders", "depth", "grounding"]


def ratio(part: Column, whole: Column) -> Column:
    """part/whole in ten-thousandths; 1 where there is nothing to count."""
    whole = whole.cast("long")
    return F.when(whole == 0, 10000).otherwise(F.floor((part.cast("long") * 20000 + whole) / (whole * 2))).cast("int")


def _count(conds) -> Column:
    return sum((F.when(c, 1).otherwise(0) for c in conds), F.lit(0))


def section_parts(text: Column) -> Column:
    """The text cut before every ``## ``, so that a heading that occurs starts a part."""
    return F.split(text, "(?=## )")


def heading_positions(parts: Column) -> Column:
    """The first part, from 1, that starts with each heading; 0 where the heading is absent."""
    label = lambda p: F.coalesce(*[F.when(p.startswith(h), F.lit(i)) for i, h in enumerate(D.HEADINGS)])
    return bound(F.transform(parts, label), lambda labels: F.array(*[F.array_position(labels, i).cast("int") for i in range(len(D.HEADINGS))]))


def _bodies(parts: Column, pos: Column):
    """(present, body) of every heading. A section ends at the next listed heading behind it."""
    out = []
    for i, heading in enumerate(D.HEADINGS):
        start = F.get(pos, F.lit(i))
        later = [F.when(F.get(pos, F.lit(j)) > start, F.get(pos, F.lit(j))) for j in range(i + 1, len(D.HEADINGS))]
        end = F.coalesce(*later, F.size(parts) + 1)
        whole = F.array_join(F.slice(parts, F.greatest(start, F.lit(1)), F.greatest(F.lit(0), end - start)), "")
        out.append((start > 0, F.substr(whole, F.lit(len(heading) + 1))))
    return out


def _words_at_least(n: int) -> str:
    """Regex of a text with ``n`` words or more: it is tried at the start only, and stops at the last word asked for."""
    return r"\A\s*+\S++(?:\s++\S++){%d}" % (n - 1)


def split_sections(docs: DataFrame) -> DataFrame:
    """(doc_key, section, heading, n_words) of the sections a document has."""
    base = docs.withColumn("parts", section_parts(F.col("text"))).withColumn("pos", heading_positions(F.col("parts")))
    parts = F.array(*[F.when(here, F.struct(F.lit(i + 1).alias("section"), F.lit(D.HEADINGS[i]).alias("heading"),
                                            word_count(body).alias("n_words")))
                      for i, (here, body) in enumerate(_bodies(F.col("parts"), F.col("pos")))])
    return base.select("doc_key", F.explode(F.array_compact(parts)).alias("s")).select("doc_key", "s.*")


def _lines_with(text: Column, regex: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(regex))


def requirement_ids(docs: DataFrame) -> DataFrame:
    """Distinct FR and NFR ids of every document."""
    ids = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(f"({D.FR_ID})"), F.lit(1)),
                                    F.regexp_extract_all("text", F.lit(f"({D.NFR_ID})"), F.lit(1))))
    return docs.select("doc_key", "repo", F.explode(ids).alias("req_id"))


def _stakeholder_points(text: Column) -> Column:
    start = F.instr(text, F.lit(D.HEADINGS[3]))
    tail = F.substr(text, start)
    stop = F.locate("\n## ", tail, 11)
    section = F.when(stop > 0, F.substr(tail, F.lit(1), stop - 1)).otherwise(tail)
    rows = F.filter(F.split(section, "\n"), lambda x: F.trim(x).startswith("|") & ~x.contains("---") & ~x.contains("Role"))
    role = lambda row: F.get(F.filter(F.transform(F.split(F.lower(row), r"\|"), lambda c: F.trim(c)), lambda c: c != ""), F.lit(0))
    named = F.exists(rows, lambda r: F.coalesce(~role(r).isin(D.GENERIC_ROLES), F.lit(False)))
    return F.when(start == 0, 10000).when(F.size(rows) == 0, 5000).when(named, 10000).otherwise(6000)


def term_regex(term: str) -> str:
    return r"(?i)\b" + term + r"s?\b"


def mentions(text: Column, lowered: Column | None = None) -> Column:
    """Which of the technology terms a text mentions, in rule order; a byte search goes first."""
    lowered = F.lower(text) if lowered is None else lowered
    return F.array(*[lowered.contains(t.lower()) & text.rlike(term_regex(t)) for t, _ in D.GROUNDING])


def fr_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({D.FR_ID})"), F.lit(1)))


def id_forms(text: Column) -> Column:
    """Every requirement id that a text contains: ``FR-12`` also contains ``FR-1``."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"FR-(\d+)"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(runs, lambda d: F.transform(
        F.sequence(F.lit(1), F.length(d)), lambda k: F.concat(F.lit("FR-"), F.substring(d, 1, k))))))


def _shared(docs: DataFrame) -> DataFrame:
    """What several scores use, in one projection, so that it is computed once per document."""
    text = F.col("text")
    base = docs.withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("parts", section_parts(text)).withColumn("pos", heading_positions(F.col("parts"))).withColumn("lowered", F.lower("text")) \
               .withColumn("id_lines", F.filter(F.split(text, "\n"), lambda x: x.contains("FR-")))
    return base.withColumn("fr", F.filter("id_lines", lambda x: x.rlike(D.FR_ID))) \
               .withColumn("nfr", F.filter("id_lines", lambda x: x.rlike(D.NFR_ID)))


def _score_columns() -> list[Column]:
    text, lower, fr, nfr = F.col("text"), F.col("lowered"), F.col("fr"), F.col("nfr")
    bodies = _bodies(F.col("parts"), F.col("pos"))
    deep = [here & body.rlike(_words_at_least(60 if i == 0 else 30)) for i, (here, body) in enumerate(bodies)]
    return [
        ratio(_count([here for here, _ in bodies]), F.lit(len(bodies))).alias("completeness"),
        F.greatest(F.lit(0), 10000 - 1000 * _count([lower.contains(p) for p in D.CLARITY])).alias("clarity"),
        ratio(F.size(F.filter(fr, lambda x: x.rlike(D.TESTABLE))), F.size(fr)).alias("testability"),
        ratio(F.size(F.filter(nfr, lambda x: ~x.rlike(D.PLACEHOLDER))), F.size(nfr)).alias("nfr_specificity"),
        _stakeholder_points(text).alias("stakeholders"),
        ratio(_count(deep), F.greatest(_count([here for here, _ in bodies]), F.lit(1))).alias("depth"),
        mentions(text, lower).alias("mentioned")]


def text_scores(docs: DataFrame) -> DataFrame:
    """Every score that needs the text only, plus the mentioned terms. Drops the text."""
    return _shared(docs).select("doc_key", "repo", *_score_columns())


def measure(docs: DataFrame, features: DataFrame, issues: bool = False) -> DataFrame:
    """Every document without its text: scores, requirement ids, and the feature names it contains.

    The text is read in one pass; ``names`` and ``id_forms`` are looked up by the caller. With
    ``issues`` the rows also have the issues that follow from the text alone.
    """
    base = _shared(docs)
    columns = [*_score_columns(), fr_ids(F.col("text")).alias("fr_ids"), id_forms(F.col("text")).alias("id_forms")]
    if issues:
        columns.append(_text_issues().alias("issues"))
    return hold(with_names(base.select("doc_key", "repo", "text", *columns), _searched(features)))


def references(docs: DataFrame, features: DataFrame) -> DataFrame:
    """(doc_key, repo, id_forms, names) of every document: what it mentions, without its text."""
    text = F.coalesce("text", F.lit(""))
    return hold(with_names(docs.select("doc_key", "repo", text.alias("text"), id_forms(text).alias("id_forms")), _searched(features)))


def ungrounded(mentioned: Column) -> Column:
    """Terms mentioned without evidence; null evidence means nothing can be checked."""
    return F.array_compact(F.array(*[F.when(F.get(mentioned, F.lit(i)) & ~F.col(flag), F.lit(term))
                                     for i, (term, flag) in enumerate(D.GROUNDING)]))


def _flags(ev: DataFrame) -> DataFrame:
    return ev.select("repo", F.lit(True).alias("known"), *sorted({f for _, f in D.GROUNDING}))


def grounding_scores(scored: DataFrame, ev: DataFrame) -> DataFrame:
    """Mentioned terms against the evidence flags of the repository."""
    out = salted_join(scored, _flags(ev), ["repo"], how="left")
    told = _count([F.get("mentioned", F.lit(i)) for i in range(len(D.GROUNDING))])
    bad = F.when(F.col("known"), F.size(ungrounded(F.col("mentioned")))).otherwise(0)
    return out.withColumn("n_ungrounded", bad).withColumn("grounding", ratio(told - bad, told)) \
              .drop("known", "mentioned", *sorted({f for _, f in D.GROUNDING}))


def claims(docs: DataFrame, ev: DataFrame) -> DataFrame:
    """(doc_key, term, flag) of the claims no evidence supports."""
    from .evidence import unpivot_flags
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(term_regex(t)), F.struct(F.lit(t).alias("term"), F.lit(f).alias("flag")))
                                      for t, f in D.GROUNDING]))
    told = docs.select("doc_key", "repo", F.explode(found).alias("r")).select("doc_key", "repo", "r.*")
    return salted_join(told, unpivot_flags(ev).filter("not value"), ["repo", "flag"]).select("doc_key", "term", "flag")


def _known_ids(frs: DataFrame) -> DataFrame:
    return frs.select("repo", "req_id").distinct()


def _unknown(ids: DataFrame, frs: DataFrame) -> DataFrame:
    return salted_join(ids, _known_ids(frs), ["repo", "req_id"], how="left_anti").select("doc_key", "req_id")


def phantom_ids(docs: DataFrame, frs: DataFrame) -> DataFrame:
    """FR ids of a document that the repository does not have."""
    return _unknown(docs.select("doc_key", "repo", F.explode(fr_ids(F.col("text"))).alias("req_id")), frs)


def _phantom_scores(ids: DataFrame, frs: DataFrame) -> DataFrame:
    n = salted_join(ids, _known_ids(frs).withColumn("known", F.lit(1)), ["repo", "req_id"], how="left").groupBy("doc_key").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("known", F.lit(0))).alias("ok"))
    return n.select("doc_key", ratio(F.col("ok"), F.col("n")).alias("phantom_ids"), (F.col("n") - F.col("ok")).alias("n_phantom"))


def score_phantom_ids(docs: DataFrame, frs: DataFrame) -> DataFrame:
    """One equi join of the ids in the documents with the known ids."""
    return _phantom_scores(docs.select("doc_key", "repo", F.explode(fr_ids(F.col("text"))).alias("req_id")), frs)


def named_features(features: DataFrame) -> DataFrame:
    """Features that have a name, with the form readers see; (repo, ord) identifies one."""
    return features.filter("name <> ''").select("repo", "name", "ord", display(F.col("name")).alias("shown"))


def _searched(features: DataFrame) -> DataFrame:
    """Both forms of every name, as the names to look for."""
    return named_features(features).select(F.explode(F.array("name", "shown")).alias("name"))


def found_features(refs: DataFrame, features: DataFrame) -> DataFrame:
    """(doc_key, ord) of the features of its repository that a document names, in either form."""
    forms = named_features(features).select("repo", "ord", F.explode(F.array_distinct(F.array("name", "shown"))).alias("form"))
    told = refs.select("doc_key", "repo", F.explode("names").alias("form"))
    return salted_join(told, forms, ["repo", "form"]).select("doc_key", "ord").distinct()


def lacking_features(refs: DataFrame, features: DataFrame) -> DataFrame:
    """(doc_key, repo, name, shown, ord) of the features that a document does not name.

    Rows of this list are what the caller asked for; there is none for a feature that is named.
    """
    wanted = salted_join(refs.select("doc_key", "repo"), named_features(features), ["repo"])
    return wanted.join(found_features(refs, features), ["doc_key", "ord"], "left_anti").select("doc_key", "repo", "name", "shown", "ord")


def found_ids(refs: DataFrame, frs: DataFrame) -> DataFrame:
    """(doc_key, req_id) of the requirements of its repository whose id a document contains."""
    told = refs.select("doc_key", "repo", F.explode("id_forms").alias("req_id"))
    return salted_join(told, _known_ids(frs), ["repo", "req_id"]).select("doc_key", "req_id")


def lacking_ids(refs: DataFrame, frs: DataFrame) -> DataFrame:
    """(doc_key, repo, req_id) of the requirements that a document does not contain."""
    wanted = salted_join(refs.select("doc_key", "repo"), _known_ids(frs), ["repo"])
    return wanted.join(found_ids(refs, frs), ["doc_key", "req_id"], "left_anti").select("doc_key", "repo", "req_id")


def _missing(refs: DataFrame, features: DataFrame, frs: DataFrame) -> DataFrame:
    names = lacking_features(refs, features).select("doc_key", F.lit("feature").alias("kind"), F.col("shown").alias("item"))
    return names.unionByName(lacking_ids(refs, frs).select("doc_key", F.lit("requirement").alias("kind"), F.col("req_id").alias("item")))


def missing_references(docs: DataFrame, features: DataFrame, frs: DataFrame) -> DataFrame:
    """Names and ids that a document does not mention."""
    return _missing(references(docs, features), features, frs)


def _trace(refs: DataFrame, features: DataFrame, frs: DataFrame) -> DataFrame:
    """Counts only: what a document names against what its repository has."""
    names = found_features(refs, features).groupBy("doc_key").agg(F.count("*").alias("ok"))
    ids = found_ids(refs, frs).groupBy("doc_key").agg(F.count("*").alias("id_ok"))
    has = named_features(features).groupBy("repo").agg(F.count("*").alias("n"))
    needs = frs.groupBy("repo").agg(F.count_distinct("req_id").alias("id_n"))
    per_repo = has.join(needs, "repo", "full")
    out = (salted_join(refs.select("doc_key", "repo"), per_repo, ["repo"], how="left").join(names, "doc_key", "left")
           .join(ids, "doc_key", "left").na.fill(0, ["n", "ok", "id_n", "id_ok"]))
    total, ok = F.col("n") + F.col("id_n"), F.col("ok") + F.col("id_ok")
    return out.select("doc_key", ratio(ok, total).alias("traceability"), (total - ok).alias("n_missing"))


def score_traceability(docs: DataFrame, features: DataFrame, frs: DataFrame) -> DataFrame:
    """Share of feature names and requirement ids that the document mentions."""
    return _trace(references(docs, features), features, frs)


def scored(measured: DataFrame, features: DataFrame, frs: DataFrame, ev: DataFrame) -> DataFrame:
    """Scores of measured documents."""
    out = grounding_scores(measured.drop("fr_ids", "id_forms", "names", "issues"), ev)
    out = out.join(_trace(measured, features, frs), "doc_key", "left")
    out = out.join(_phantom_scores(measured.select("doc_key", "repo", F.explode("fr_ids").alias("req_id")), frs), "doc_key", "left")
    out = out.na.fill(10000, ["phantom_ids", "traceability"]).na.fill(0, ["n_phantom", "n_missing"])
    total = sum((F.col(d) for d in DIMENSIONS), F.lit(0))
    score = F.floor((2 * total + 9) / 18)
    revise = (score < int(D.PASS_MARK * 10000)) | (F.col("grounding") < 10000) | (F.col("phantom_ids") < 10000)
    return out.select("doc_key", "repo", *[(F.col(d) / 10000).alias(d) for d in DIMENSIONS],
                      (score / 10000).alias("score"), revise.alias("needs_revision"))


def score_document(docs: DataFrame, features: DataFrame, frs: DataFrame, ev: DataFrame) -> DataFrame:
    """Nine scores, their mean, and whether the document needs a revision."""
    return scored(measure(docs, features), features, frs, ev)


def _issue(dimension: int, *message) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]).alias("issue"))


def _text_issues() -> Column:
    """Issues that follow from the text alone, over the columns of ``_shared``."""
    text, lower, T = F.col("text"), F.col("lowered"), D.ISSUE_TEXTS
    first_id = lambda x, rx: F.regexp_extract(x, f"({rx})", 1)
    own = [F.array_compact(F.array(
        *[F.when(~text.contains(h), _issue(1, T["section"][0], h, T["section"][1])) for h in D.HEADINGS],
        *[F.when(lower.contains(p), _issue(4, T["phrase"][0], p, T["phrase"][1])) for p in D.CLARITY]))]
    own.append(F.transform(F.filter("fr", lambda x: ~x.rlike(D.TESTABLE)), lambda x: _issue(5, first_id(x, D.FR_ID), T["untestable"])))
    own.append(F.transform(F.filter("nfr", lambda x: x.rlike(D.PLACEHOLDER)), lambda x: _issue(6, first_id(x, D.NFR_ID), T["placeholder"])))
    points = _stakeholder_points(text)
    own.append(F.array_compact(F.array(F.when(points == 5000, _issue(7, T["no_stakeholders"])), F.when(points == 6000, _issue(7, T["generic_roles"])))))
    shallow = []
    for i, (here, body) in enumerate(_bodies(F.col("parts"), F.col("pos"))):
        n, least = word_count(body), 60 if i == 0 else 30
        before, behind = T["summary"] if i == 0 else (T["shallow"][0] + D.HEADINGS[i][3:] + T["shallow"][1], T["shallow"][2])
        shallow.append(F.when(here & (n < least), _issue(8, before, n.cast("string"), behind)))
    own.append(F.array_compact(F.array(*shallow)))
    return F.concat(*own)


def document_issues(docs: DataFrame, features: DataFrame, frs: DataFrame, ev: DataFrame) -> DataFrame:
    """Issues as rows (doc_key, dimension, issue), dimension in score order; the texts are read once."""
    T = D.ISSUE_TEXTS
    m = measure(docs, features, issues=True)
    rows = m.select("doc_key", F.explode("issues").alias("i")).select("doc_key", "i.*")
    lacking = F.when(F.col("kind") == "feature", _issue(2, T["feature"][0], F.col("item"), T["feature"][1])) \
        .otherwise(_issue(2, T["requirement"][0], F.col("item"), T["requirement"][1]))
    trace = _missing(m, features, frs).select("doc_key", lacking.alias("i")).select("doc_key", "i.*")
    ids = m.select("doc_key", "repo", F.explode("fr_ids").alias("req_id"))
    ghosts = _unknown(ids, frs).select("doc_key", _issue(3, T["phantom"][0], F.col("req_id"), T["phantom"][1]).alias("i")).select("doc_key", "i.*")
    told = salted_join(m.select("doc_key", "repo", "mentioned"), _flags(ev), ["repo"])
    false = F.array_compact(F.array(*[F.when(F.get("mentioned", F.lit(i)) & ~F.col(flag), _issue(9, T["ungrounded"][0] + term + T["ungrounded"][1] + flag + T["ungrounded"][2]))
                                      for i, (term, flag) in enumerate(D.GROUNDING)]))
    ground = told.select("doc_key", F.explode(false).alias("i")).select("doc_key", "i.*")
    return rows.unionByName(trace).unionByName(ghosts).unionByName(ground)


def quoted(phrase: str) -> str:
    return "(?i)" + re.escape(phrase).replace(r"\ ", " ")
