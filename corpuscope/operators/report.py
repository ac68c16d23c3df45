"""Report tables and the assembled report.

A report is a table of lines (repo, section, block, ord, sub, line). Sections that list
features or requirements may have any number of lines, so lines stay rows; ``render_report``
joins them into text in parts of bounded size, and the document writer sorts them into files.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_any, display, lit_array, numbered, percent
from ..rules import documents as D, packs as P
from .features import component_layer
from .numbering import number_rows, top_k, with_ids


# ---- tables of the sections ----------------------------------------------------------------

def layer_inventory(features: DataFrame) -> DataFrame:
    """Layer, display name and confidence of every feature; domain text for domain features."""
    domain = contains_any(F.col("name"), P.DOMAIN_WORDS)
    return features.select("repo", "ord", component_layer(F.col("name")).alias("layer"), display(F.col("name")).alias("component"),
                           percent(F.col("conf") / 100).alias("confidence"),
                           F.when(domain, F.substring_index("description", ".", 1)).alias("domain_text"))


def interface_table(ev: DataFrame, endpoints: DataFrame, rpcs: DataFrame) -> DataFrame:
    """Up to 12 endpoints, else up to 8 RPCs, else a row that says there are none."""
    eps = top_k(endpoints, ["repo"], ["source_file", "line", "kind"], 12).select(
        "repo", F.col("rank").alias("ord"), F.lit("endpoint").alias("kind"),
        F.concat_ws(" | ", "handler", "method", "path", "source_file").alias("entry"))
    rp = top_k(rpcs, ["repo"], ["source_file", "pos"], 8).select(
        "repo", F.col("rank").alias("ord"), F.lit("rpc").alias("kind"),
        F.concat_ws(" | ", "service", "rpc", "request", "response", "source_file").alias("entry"))
    flags = ev.select("repo", "has_http_api", "has_grpc")
    eps = eps.join(flags.filter("has_http_api").select("repo"), "repo", "left_semi")
    rp = rp.join(flags.filter("not has_http_api and has_grpc").select("repo"), "repo", "left_semi")
    none = flags.filter("not has_http_api and not has_grpc").select(
        "repo", F.lit(1).alias("ord"), F.lit("none").alias("kind"), F.lit(D.NO_INTERFACE).alias("entry"))
    return eps.unionByName(rp).unionByName(none)


def _pairs(rows):
    return F.array(*[F.struct(F.lit(a).alias("aspect"), (b if isinstance(b, Column) else F.lit(b)).alias("specification")) for a, b in rows])


def data_rows(ev: DataFrame, deps: DataFrame) -> DataFrame:
    """I4: persistence rows from the first three database dependencies, and the retention policy."""
    from .manifests import dep_bucket
    db = deps.filter(dep_bucket(F.col("name"), F.col("category")) == "database") \
        .groupBy("repo", "name").agg(F.min("seq").alias("seq"))
    lead = top_k(db, ["repo"], ["seq"], 3).groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("storage"))  # three at most
    storage = F.coalesce("storage", F.lit("Relational database (inferred from framework)"))
    policy = lambda key: [("Policy", t) for t in D.DATA_POLICY[key]]
    rows = F.concat(_pairs([("Storage Paradigm", storage)] + D.DATA_ROWS),
                    F.when(F.col("has_gdpr_mention"), _pairs(policy("gdpr"))).when(F.col("has_auth"), _pairs(policy("auth"))).otherwise(_pairs(policy("none"))))
    none = _pairs([("Persistence", D.NO_DATA[0]), ("Policy", D.NO_DATA[1])])
    out = ev.join(lead, "repo", "left")
    return out.select("repo", F.posexplode(F.when(F.col("has_database"), rows).otherwise(none)).alias("ord", "r")).select("repo", "ord", "r.*")


def purpose_token(name: Column) -> Column:
    """B15, token mode: the fragment must stand between non-letters."""
    return _purpose(name, P.PURPOSE_TOKEN, lambda n, f: n.rlike(r"(?<![a-z])" + f + r"(?![a-z])"))


def purpose_substring(name: Column) -> Column:
    """B15, substring mode."""
    return _purpose(name, P.PURPOSE_SUBSTRING, lambda n, f: n.contains(f))


def _purpose(name, rules, test):
    lower = F.lower(name)
    labels = F.array_compact(F.array(*[F.when(test(lower, f), F.lit(label)) for f, label in rules]))
    return F.coalesce(F.get(labels, F.lit(0)), F.lit(P.PURPOSE_DEFAULT))


def tech_purpose(labels: DataFrame, mode: str = "substring") -> DataFrame:
    """What a technology is for, by the first fragment of its name."""
    fn = purpose_token if mode == "token" else purpose_substring
    return labels.select("repo", "ord", "label", fn(F.col("label")).alias("purpose"))


def stack_table(labels: DataFrame) -> DataFrame:
    """I5"""
    return tech_purpose(labels).select("repo", "ord", "label", F.lit("Confirmed").alias("status"),
                                       F.lit("Latest Stable").alias("version"), "purpose")


def infra_rows(ev: DataFrame, labels: DataFrame) -> DataFrame:
    """Infrastructure aspects that the evidence supports."""
    serverless = labels.groupBy("repo").agg(F.bool_or(contains_any(F.lower("label"), ["serverless", "lambda"])).alias("serverless"))
    out = ev.join(serverless, "repo", "left").na.fill(False, ["serverless"])
    block = lambda head, rows: _pairs([("Target Architecture", head)] + rows)
    rows = (F.when(F.col("has_android") | F.col("has_ios"), block(*D.INFRA_MOBILE))
            .when(F.col("has_desktop"), block(*D.INFRA_DESKTOP))
            .when(F.col("has_kubernetes"), block(D.INFRA_K8S, D.INFRA_ROWS))
            .when(F.col("has_docker"), block(D.INFRA_DOCKER, D.INFRA_ROWS))
            .when(F.col("serverless"), block(D.INFRA_SERVERLESS, D.INFRA_ROWS))
            .otherwise(block(*D.INFRA_NONE)))
    return out.select("repo", F.posexplode(rows).alias("ord", "r")).select("repo", "ord", "r.*")


def risk_register(features: DataFrame, repos: DataFrame) -> DataFrame:
    """One risk per feature below 0.6 and two that always hold."""
    low = features.filter("conf < 60").select("repo", F.lit(0).alias("kind"), "ord", F.concat(
        F.lit("Ambiguous Implementation: "), display(F.col("name"))).alias("risk"), F.lit("Medium").alias("probability"),
        F.lit("High").alias("impact"), F.lit("Conduct code-level discovery").alias("mitigation"))
    fixed = F.array(*[F.struct(F.lit(i).alias("ord"), *[F.lit(v).alias(n) for n, v in zip(("risk", "probability", "impact", "mitigation"), r)])
                      for i, r in enumerate(D.RISKS)])
    always = repos.select("repo").distinct().select("repo", F.lit(1).alias("kind"), F.explode(fixed).alias("r")).select("repo", "kind", "r.*")
    return with_ids(low.unionByName(always), ["repo"], ["kind", "ord"], "R-", 2, "risk_id") \
        .select("repo", F.col("n").alias("ord"), "risk_id", "risk", "probability", "impact", "mitigation")


def compliance_rows(ev: DataFrame) -> DataFrame:
    """I8"""
    row = lambda d, r, s: F.struct(F.lit(d).alias("domain"), F.lit(r).alias("requirement"), F.lit(s).alias("strategy"))
    gated = F.array_compact(F.array(*[F.when(F.col(flag) if flag else F.lit(True), row(*r)) for flag, *r in D.COMPLIANCE_ROWS]))
    anything = F.col("has_http_api") | F.col("has_auth") | F.col("has_gdpr_mention")
    rows = F.when(anything, gated).otherwise(F.array(row(*D.COMPLIANCE_NONE)))
    return ev.select("repo", F.posexplode(rows).alias("ord", "r")).select("repo", "ord", "r.*")


def open_issues(features: DataFrame, labels: DataFrame, repos: DataFrame) -> DataFrame:
    """At most three issues per repository, or one that says there are none."""
    stats = features.groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("conf") < 60).alias("low"))
    stack = labels.groupBy("repo").agg(F.count("*").alias("labels"))
    out = repos.select("repo").distinct().join(stats, "repo", "left").join(stack, "repo", "left").na.fill(0)
    found = F.array_compact(F.array(F.when(F.col("n") < 5, D.ISSUE_FEW),
                                    F.when(F.col("low") > 0, F.concat(F.col("low").cast("string"), F.lit(D.ISSUE_LOW))),
                                    F.when(F.col("labels") == 0, D.ISSUE_STACK)))
    found = F.when(F.size(found) == 0, F.array(F.lit(D.ISSUE_NONE))).otherwise(found)
    return out.select("repo", F.posexplode(found).alias("ord", "issue")).select(
        "repo", "ord", numbered("OI-", F.col("ord") + 1, 2).alias("issue_id"), "issue")


def stakeholder_rows(business: DataFrame) -> DataFrame:
    """Primary users and three fixed roles; the first three users are personas."""
    users = F.transform(F.split("primary_users", ", "), lambda u, i: F.struct(
        u.alias("role"), F.lit("Primary Actor").alias("responsibility"), F.lit("High").alias("impact"), (i < 3).alias("persona")))
    fixed = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(d).alias("responsibility"), F.lit(i).alias("impact"), F.lit(False).alias("persona"))
                      for r, d, i in D.FIXED_ROLES])
    return business.select("repo", F.posexplode(F.concat(users, fixed)).alias("ord", "r")).select("repo", "ord", "r.*")


def scope_and_goals(features: DataFrame) -> DataFrame:
    """Goals, up to eight features in scope, and what is out of scope."""
    auth = features.groupBy("repo").agg(F.bool_or(F.lower("name").contains("auth")).alias("auth"))
    goals = []
    for gid, goal, metric in D.GOALS:
        pick = lambda i: F.when(F.col("auth"), D.GOAL_AUTH[i]).otherwise(D.GOAL_NO_AUTH[i])
        goals.append(F.struct(F.lit("goal").alias("kind"), F.concat_ws(" | ", F.lit(gid), F.lit(goal) if goal else pick(0),
                                                                       F.lit(metric) if metric else pick(1)).alias("entry")))
    outside = [F.struct(F.lit("out_of_scope").alias("kind"), F.lit(t).alias("entry")) for t in D.OUT_OF_SCOPE]
    fixed = auth.select("repo", F.posexplode(F.array(*goals, *outside)).alias("ord", "e")).select("repo", "ord", "e.*")
    lead = top_k(features.filter("conf >= 80").select("repo", "ord", "name"), ["repo"], ["ord"], 8)
    inside = lead.select("repo", F.col("rank").alias("ord"), F.lit("in_scope").alias("kind"), display(F.col("name")).alias("entry"))
    empty = features.select("repo").distinct().join(inside.select("repo").distinct(), "repo", "left_anti").select(
        "repo", F.posexplode(lit_array(D.DEFAULT_SCOPE)).alias("ord", "entry")).select("repo", F.col("ord") + 1, F.lit("in_scope"), "entry").toDF("repo", "ord", "kind", "entry")
    return fixed.unionByName(inside).unionByName(empty)


def executive_rows(features: DataFrame, business: DataFrame) -> DataFrame:
    """Counts of features and sure features, with the business context."""
    stats = features.groupBy("repo").agg(F.count("*").alias("n_features"), F.count_if(F.col("conf") >= 80).alias("n_core"),
                                         F.count_if(F.col("conf") < 60).alias("n_review"))
    return business.join(stats, "repo").select("repo", "product_type", "core_value", "n_features", "n_core", "n_review")


def review_items(features: DataFrame) -> DataFrame:
    """The first three features below 0.6."""
    low = top_k(features.filter("conf < 60").select("repo", "ord", "name", "description"), ["repo"], ["ord"], 3)
    return low.select("repo", F.col("rank").alias("ord"), display(F.col("name")).alias("item"), "description")


# ---- assembly ---------------------------------------------------------------------------------

def _lines(df, section, block, ord_col, line, sub=0):
    o = F.col(ord_col) if isinstance(ord_col, str) else F.lit(ord_col)
    return df.select("repo", F.lit(section).alias("section"), F.lit(block).alias("block"), o.cast("long").alias("ord"),
                     F.lit(sub).alias("sub"), line.alias("line"))


def _fixed(df, section, block, texts):
    """The same lines for every repository of ``df``; a text may be a Column."""
    arr = F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])
    return df.select("repo", F.posexplode(arr).alias("ord", "line")).select(
        "repo", F.lit(section).alias("section"), F.lit(block).alias("block"), F.col("ord").cast("long").alias("ord"),
        F.lit(0).alias("sub"), "line")


def _row(*cols):
    parts = [F.lit("| ")]
    for i, c in enumerate(cols):
        parts += ([F.lit(" | ")] if i else []) + [c if isinstance(c, Column) else F.col(c)]
    return F.concat(*parts, F.lit(" |"))


def report_lines(t: dict, date: str) -> DataFrame:
    """All lines of the report of every repository.

    ``t`` holds the tables: repos, executive, review, summary, capabilities, scope, inventory,
    stakeholders, requirements, interfaces, nfrs, data, stack, infra, risks, compliance, issues,
    and glossary (optional). The date is a parameter, so a run can be repeated.
    """
    repos, one = t["repos"].select("repo").distinct(), t["executive"]
    has_terms = t.get("glossary") is not None
    contents = D.CONTENTS + (["17. Glossary of Technical Terms"] if has_terms else [])
    out = [
        _fixed(one, 0, 0, ["# BUSINESS REQUIREMENTS DOCUMENT (BRD)", "", F.concat(F.lit("**Project / Repository:** "), "repo", F.lit("  ")),
                           F.concat(F.lit("**System Archetype:** "), "product_type", F.lit("  ")), "**Document Version:** 1.0 — Final  ",
                           f"**Date:** {date}  ", "**Status:** Formal Review  ", "", "---", "", "## Table of Contents", "", *contents, "", "---", ""]),
        _fixed(one, 1, 0, ["## 1. Executive Summary", "", F.concat(
            F.lit("This Business Requirements Document (BRD) specifies the functional, non-functional, and technical requirements for the **"), "product_type",
            F.lit("**. Based on comprehensive static analysis, the system encompasses **"), F.col("n_features").cast("string"),
            F.lit(" functional domains**, of which **"), F.col("n_core").cast("string"),
            F.lit("** have been identified as high-confidence core capabilities. "), "core_value"), "", "**System Overview:**"]),
        _lines(t["summary"], 1, 1, 0, F.col("summary")), _fixed(repos, 1, 2, ["", "**Core Capabilities:**"]),
        _lines(t["capabilities"], 1, 3, "rank", F.concat(F.lit("- "), "capability")),
        _lines(t["review"].filter("ord = 1"), 1, 4, 0, F.lit("**Areas Requiring Review:**")),
        _lines(t["review"], 1, 5, "ord", F.concat(F.lit("- **"), "item", F.lit("**: "), "description")), _fixed(repos, 1, 6, ["", "---", ""]),
        _fixed(repos, 2, 0, ["## 2. Business Context & Objectives", "", "### 2.1 Business Problem Statement", "", D.PROBLEM, "",
                             "### 2.2 Project Goals", "", "| # | Goal | Success Metric |", "|---|---|---|"]),
        _lines(t["scope"].filter("kind = 'goal'"), 2, 1, "ord", F.concat(F.lit("| "), "entry", F.lit(" |"))),
        _fixed(repos, 2, 2, ["", "### 2.3 Project Scope", "", "#### In Scope", ""]),
        _lines(t["scope"].filter("kind = 'in_scope'"), 2, 3, "ord", F.concat(F.lit("- "), "entry")), _fixed(repos, 2, 4, ["", "#### Out of Scope", ""]),
        _lines(t["scope"].filter("kind = 'out_of_scope'"), 2, 5, "ord", F.concat(F.lit("- "), "entry")), _fixed(repos, 2, 6, ["", "---", ""]),
        _fixed(one, 3, 0, ["## 3. Current State Analysis (AS-IS)", "", "### 3.1 Architecture Overview", "", F.concat(
            F.lit("The "), "product_type", F.lit(" comprises multiple functional boundaries mapped during static analysis.")), "",
            "| Layer / Component | Detected Module | Confidence |", "|---|---|---|"]),
        _lines(t["inventory"], 3, 1, "ord", _row("layer", "component", "confidence")),
        _fixed(repos, 3, 2, ["", "### 3.2 Domain Entity Catalogue", "", "| Entity / Domain | Type | Description |", "|---|---|---|"]),
        _lines(t["inventory"].filter("domain_text is not null"), 3, 3, "ord", _row("component", F.lit("Core Entity / Subsystem"), "domain_text")),
        _lines(repos.join(t["inventory"].filter("domain_text is not null").select("repo").distinct(), "repo", "left_anti"), 3, 3, 0,
               F.lit("| System Object | Generic Entity | Represents core state |")), _fixed(repos, 3, 4, ["", "---", ""]),
        _fixed(repos, 4, 0, ["## 4. Stakeholders & Personas", "", "### 4.1 Stakeholder Matrix", "", "| Role | Responsibility | Impact |", "|---|---|---|"]),
        _lines(t["stakeholders"], 4, 1, "ord", _row("role", "responsibility", "impact")), _fixed(repos, 4, 2, ["", "### 4.2 User Personas", ""]),
        *[_lines(t["stakeholders"].filter("persona"), 4, 3, "ord", x, i) for i, x in enumerate([
            F.concat(F.lit("#### Persona "), (F.col("ord") + 1).cast("string"), F.lit(" — "), "role"),
            F.lit("- **Role:** Interacts with the system to fulfill business workflows."),
            F.lit("- **Needs:** High availability, data integrity, and intuitive interfaces."),
            F.lit("- **Pain Points:** Complex navigation, slow response times."), F.lit("")])], _fixed(repos, 4, 4, ["---", ""]),
        _fixed(repos, 5, 0, ["## 5. Functional Requirements", "", "Requirements are categorized by their originating architectural feature. Each requirement is presented in plain English first, followed by the precise technical specification.", ""]),
    ]
    fr = t["requirements"]
    first = fr.groupBy("repo", "feature_ord").agg(F.min("ord").alias("ord"), F.min_by("feature", "ord").alias("feature"),
                                                  F.min_by("feature_text", "ord").alias("feature_text"))
    out += [_lines(first, 5, 1, "ord", x, i) for i, x in enumerate([
        F.lit(""), F.concat(F.lit("### 5.x Feature: "), "feature"), F.lit(""), F.concat(F.lit("**What this feature does:** "), "feature_text"), F.lit(""),
        F.lit("| ID | Plain English | Technical Specification | Business Impact | Priority |"), F.lit("|---|---|---|---|---|")])]
    nfr_row = _row(F.concat(F.lit("**"), "req_id", F.lit("**")), "description", F.lit("Strict — to be defined during discovery"),
                   F.lit("Degraded user experience or system failure."))
    out += [
        _lines(fr, 5, 1, "ord", _row(F.concat(F.lit("**"), "req_id", F.lit("**")), "plain", "technical", "impact", "priority"), 10),
        _lines(fr.filter("verified_by is not null"), 5, 1, "ord", F.concat(F.lit("| | *Verified by:* "), "verified_by", F.lit(" | | | |")), 11),
        _fixed(repos, 5, 2, ["", "### Proposed Integration Interfaces", ""]),
        _lines(t["interfaces"], 5, 3, "ord", F.when(F.col("kind") == "none", F.concat(F.lit("_"), "entry", F.lit("_"))).otherwise(F.concat(F.lit("| "), "entry", F.lit(" |")))),
        _fixed(repos, 5, 4, ["", "---", ""]),
        _fixed(repos, 6, 0, ["## 6. Non-Functional Requirements", "", "Non-functional constraints dictating system quality. Each requirement includes a plain English explanation and a specific, measurable target.", "",
                             "| ID | What This Means | Technical Target | Business Consequence |", "|---|---|---|---|"]),
        _lines(t["nfrs"], 6, 1, "ord", nfr_row), _fixed(repos, 6, 2, ["", "---", ""]),
        _fixed(repos, 7, 0, ["## 7. Data Requirements", "", "### 7.1 Database & Persistence Strategy", "", "| Requirement | Specification |", "|---|---|"]),
        _lines(t["data"].filter("aspect <> 'Policy'"), 7, 1, "ord", _row("aspect", "specification")),
        _fixed(repos, 7, 2, ["", "### 7.2 Data Retention & Compliance", ""]),
        _lines(t["data"].filter("aspect = 'Policy'"), 7, 3, "ord", F.concat(F.lit("- "), "specification")), _fixed(repos, 7, 4, ["", "---", ""]),
        _fixed(repos, 8, 0, ["## 8. Technology Stack (TO-BE)", "", "| Component / Technology | Status | Target Version | Purpose (Plain English) |", "|---|---|---|---|"]),
        _lines(t["stack"], 8, 1, "ord", _row("label", "status", "version", "purpose")), _fixed(repos, 8, 2, ["", "---", ""]),
        _fixed(repos.join(cicd_tool(t["stack"]), "repo", "left"), 9, 0, ["## 9. CI/CD Pipeline Requirements", "", F.concat(
            F.lit("**Primary Orchestrator:** "), F.coalesce("tool", F.lit(D.CICD_DEFAULT))), "", *D.CICD_LINES, "", "---", ""]),
        _fixed(repos, 10, 0, ["## 10. Infrastructure Requirements", "", "| Resource Aspect | Specification |", "|---|---|"]),
        _lines(t["infra"], 10, 1, "ord", _row("aspect", "specification")), _fixed(repos, 10, 2, ["", "---", ""]),
        _fixed(repos, 11, 0, ["## 11. Risk Register", "", "| ID | Risk Description | Probability | Impact | Mitigation Strategy | Status |", "|---|---|---|---|---|---|"]),
        _lines(t["risks"], 11, 1, "ord", _row("risk_id", "risk", "probability", "impact", "mitigation", F.lit("Open"))), _fixed(repos, 11, 2, ["", "---", ""]),
        _fixed(repos, 12, 0, ["## 12. Compliance & Legal Requirements", "", "| Domain | Requirement | Implementation Strategy |", "|---|---|---|"]),
        _lines(t["compliance"], 12, 1, "ord", _row("domain", "requirement", "strategy")), _fixed(repos, 12, 2, ["", "---", ""]),
        _fixed(repos, 13, 0, ["## 13. Acceptance Criteria", "", *D.ACCEPTANCE_LINES, "", "---", ""]),
        _fixed(repos, 14, 0, ["## 14. Delivery Roadmap", "", *D.ROADMAP_LINES, "", "---", ""]),
        _fixed(repos, 15, 0, ["## 15. Open Issues & Decisions Required", "", "| ID | Issue | Owner | Business Impact | Recommended Action | Priority |", "|---|---|---|---|---|---|"]),
        _lines(t["issues"], 15, 1, "ord", _row("issue_id", "issue", F.lit("Both"), F.lit("Undefined"), F.lit("Manual review"), F.lit("Medium"))),
        _fixed(repos, 15, 2, ["", "---", ""]),
        _fixed(repos, 16, 0, ["## 16. Document Approval", "", *D.APPROVAL_LINES, "", f"_Document generated deterministically on {date}._", ""]),
    ]
    if has_terms:
        terms = number_rows(t["glossary"], ["repo"], ["term"], "ord")
        out += [_fixed(terms.filter("ord = 1"), 17, 0, ["## 17. Glossary of Technical Terms", "", "| Term | Plain English Definition |", "|---|---|"]),
                _lines(terms, 17, 1, "ord", _row(F.concat(F.lit("**"), "term", F.lit("**")), "definition"))]
    return reduce(lambda a, b: a.unionByName(b), out)


def cicd_tool(stack: DataFrame) -> DataFrame:
    """Delivery tool named by a technology label; the later rule of the list wins."""
    hits = lambda kw: F.bool_or(F.lower("label").contains(kw))
    return stack.groupBy("repo").agg(F.coalesce(*[F.when(hits(kw), name) for kw, name in D.CICD_TOOLS]).alias("tool"))


def render_report(lines: DataFrame, part_lines: int | None = None) -> DataFrame:
    """Text of the reports, each in one part, or in parts of ``part_lines`` lines.

    A report is a document: all its lines meet in one value, as they do in its file.
    """
    if part_lines is None:
        ordered = F.array_sort(F.collect_list(F.struct("section", "block", "ord", "sub", "line")))
        return lines.groupBy("repo").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text"), F.count("*").alias("n_lines")) \
            .select("repo", F.lit(0).alias("part"), "text", "n_lines")
    placed = number_rows(lines, ["repo"], ["section", "block", "ord", "sub"], "n")
    part = F.floor((F.col("n") - 1) / part_lines).cast("int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n")  # part_lines at most
    return placed.groupBy("repo", part.alias("part")).agg(text.alias("text"), F.count("*").alias("n_lines"))
