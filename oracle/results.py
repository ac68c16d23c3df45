"""Features, requirements, documents, reports and learning, in SQL."""
from __future__ import annotations

import re

from corpuscope.rules import documents as D, packs as P, signals as S
from corpuscope.rules.languages import NEGATIVE_PATH
from corpuscope.rules.packs import LANGUAGE_TOKENS

from .build import anyword, base, case, cte, display, ext, inlist, lit, num, q, rx, snake, stripped, title, topdir, values
from .tables import BUCKETS, FLAGS, docstring, pack_where, role, uuid5

# ---- features ------------------------------------------------------------------------
cte("fallback", f"""SELECT repo, {num('feat-', 'n', 3)} AS feature_id, n::BIGINT AS ord, {title("replace(name, '_', ' ')")} || ' Component' AS name, 'Core architectural component encompassing ' || name || '.' AS description, 70 AS conf, name AS source
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY name) AS n FROM modules_norm)""")
q("fallback_features", "SELECT repo, feature_id, name, description, source FROM fallback")
cte("fb_words", "SELECT DISTINCT repo, feature_id, kw FROM (SELECT repo, feature_id, unnest(string_split(lower(replace(name, ' ', '_')), '_')) AS kw FROM fallback) WHERE length(kw) >= 3")
cte("searched", "SELECT repo, lower(path) AS lp, lower(content) AS body FROM classified")
cte("fb_files", "SELECT DISTINCT w.repo, w.feature_id, h.lp FROM fb_words w JOIN searched h ON h.repo = w.repo AND (contains(h.lp, w.kw) OR contains(h.body, w.kw))")
cte("fb_counts", f"SELECT repo, feature_id, count(*) AS n_files, count(*) FILTER (WHERE {rx('lp', NEGATIVE_PATH)}) AS n_negative FROM fb_files GROUP BY ALL")
q("feature_file_counts", "SELECT * FROM fb_counts")
# pack features
cte("surface", "SELECT *, string_split(trim(path, '/'), '/')[1] AS prefix FROM contracts")
cte("names_of", "SELECT repo, family, string_agg(signal, ', ' ORDER BY signal) AS names, count(*) AS n FROM sig_counts GROUP BY repo, family")
cte("stage_text", "SELECT * FROM (" + values(S.ML_STAGE_TEXT.items()) + ") v(signal, txt)")
cte("screen_kinds", "SELECT repo, string_split(type, '_')[1] AS prefix, count(*) AS n FROM screens GROUP BY repo, type")
cte("screen_labels", "SELECT * FROM (" + values(S.SCREEN_LABELS.items()) + ") v(prefix, shown)")
cte("packfeats", f"""
SELECT repo, prefix || '_api_surface' AS name, 'API endpoints under /' || prefix || ' (' || count(*) || ' routes: ' || array_to_string(list_slice(list(path ORDER BY kind, source_file, pat, pos), 1, 5), ', ') || ')' AS description, 85 AS conf, 'contracts' AS family, 'web_api' AS pack FROM surface GROUP BY repo, prefix
UNION ALL SELECT repo, auth_type || '_authentication', CASE WHEN standing = 'dominant' THEN 'Authentication using ' || upper(auth_type) || ' mechanism.' ELSE 'Secondary auth mechanism: ' || upper(auth_type) END, CASE WHEN standing = 'dominant' THEN 90 ELSE 60 END, 'auth', 'web_api' FROM auth WHERE standing <> 'weak'
UNION ALL SELECT repo, signal || '_middleware', {display('signal')} || ' middleware detected in ' || n_files || ' file(s)', 75, 'middleware', 'web_api' FROM sig_counts WHERE family = 'middleware'
UNION ALL SELECT p.repo, 'data_pipeline_orchestration', 'Data pipeline with ' || p.n || ' pipeline component(s) using ' || coalesce(o.names, ''), 90, 'pipelines', 'data_platform' FROM (SELECT repo, count(*) n FROM pipelines GROUP BY repo) p LEFT JOIN names_of o ON o.repo = p.repo AND o.family = 'orchestrator'
UNION ALL SELECT repo, signal || '_integration', 'Data processing integration with ' || {title('signal')}, 85, 'orchestrators', 'data_platform' FROM sig_counts WHERE family = 'orchestrator'
UNION ALL SELECT repo, 'data_source_integration', 'Data pipeline connects to ' || n || ' source/sink type(s): ' || names, 85, 'sources', 'data_platform' FROM names_of WHERE family = 'source'
UNION ALL SELECT repo, 'data_quality_framework', 'Data quality checks using: ' || names, 80, 'quality', 'data_platform' FROM names_of WHERE family = 'quality'
UNION ALL SELECT repo, signal, txt || '. Found in ' || n_files || ' file(s)', least(90, 60 + 10 * n_files), 'stages', 'ml_pipeline' FROM sig_counts JOIN stage_text USING (signal) WHERE family = 'stage'
UNION ALL SELECT repo, signal || '_model', {display('signal')} || ' model architecture detected in ' || n_files || ' file(s)', least(90, 70 + 5 * n_files), 'models', 'ml_pipeline' FROM sig_counts WHERE family = 'model'
UNION ALL SELECT repo, prefix || '_screen_navigation', shown || ' app with ' || n || ' screen(s)/page(s)', least(90, 70 + 5 * n), 'screens', 'mobile_app' FROM screen_kinds JOIN screen_labels USING (prefix)
UNION ALL SELECT repo, 'device_permission_management', 'App requests ' || count(*) || ' device permission(s)', 90, 'permissions', 'mobile_app' FROM perms GROUP BY repo
UNION ALL SELECT repo, 'cross_platform_mobile_support', 'App targets ' || count(*) || ' platform(s): ' || string_agg(platform, ', ' ORDER BY platform), 95, 'platforms', 'mobile_app' FROM mobile_marks GROUP BY repo""")
q("signal_features", "SELECT repo, name, description, conf::BIGINT AS conf, family, pack FROM packfeats")
q("pack_results", "SELECT repo, pack, name, description, conf::BIGINT AS conf, family FROM packfeats JOIN active USING (repo, pack)")
FAM = {"middleware": "web_api", "orchestrator": "data_platform", "quality": "data_platform", "metric": "ml_pipeline", "framework": "ml_pipeline"}
NOTES = [(p, "nfr_emphasis", v) for p, vs in P.PACK_EMPHASIS.items() for v in vs] + [(p, "section_notes." + s, t) for p in P.PACK_EMPHASIS for s, t in P.PACK_HINTS[p].items()]
q("pack_signals", "SELECT s.repo, f.pack || '.' || s.family AS key, s.signal AS value FROM sig_counts s JOIN (" + values(FAM.items()) + ") f(family, pack) USING (family) JOIN active a ON a.repo = s.repo AND a.pack = f.pack UNION ALL SELECT repo, pack || '.' || k, v FROM active JOIN (" + values(NOTES) + ") n(pack, k, v) USING (pack)")
q("pack_hints", "SELECT repo, section, string_agg(hint, ' ' ORDER BY score DESC, i) AS hint FROM active JOIN (" + values([(p, i, s, t) for i, (p, hs) in enumerate(P.PACK_HINTS.items()) for s, t in hs.items()]) + ") h(pack, i, section, hint) USING (pack) GROUP BY repo, section")
cte("fresh_packs", """SELECT p.repo, p.name, p.conf FROM packfeats p WHERE (p.repo, lower(replace(p.name, ' ', '_'))) NOT IN (SELECT (repo, lower(replace(name, ' ', '_'))) FROM fallback)
QUALIFY row_number() OVER (PARTITION BY p.repo, lower(replace(p.name, ' ', '_')) ORDER BY p.pack, p.family, p.name) = 1""")
q("merge_skill_features", f"SELECT repo, count(*) AS n, {num('feat-', 'count(*)', 3)} AS last_id, sum(conf)::BIGINT AS conf FROM (SELECT repo, conf FROM fallback UNION ALL SELECT repo, conf FROM fresh_packs) GROUP BY repo")

cte("calibrated", f"""SELECT repo, feature_id, ord, name, description, greatest(10, least(100, 70 + CASE WHEN n >= 6 THEN 10 WHEN n >= 3 THEN 5 WHEN n = 0 THEN -10 ELSE 0 END
 + CASE WHEN {rx('source', NEGATIVE_PATH)} THEN -20 ELSE 0 END + CASE WHEN n > 0 AND neg * 10 >= n * 8 THEN -10 ELSE 0 END))::BIGINT AS conf, n AS n_files
FROM (SELECT f.*, coalesce(n_files, 0) AS n, coalesce(n_negative, 0) AS neg FROM fallback f LEFT JOIN fb_counts USING (repo, feature_id))""")
q("calibrate_confidence", "SELECT repo, feature_id, name, conf, n_files FROM calibrated")
cte("added", """SELECT repo, name, description, conf, row_number() OVER (PARTITION BY repo ORDER BY lower(name), name) AS n FROM (SELECT p.* FROM packfeats p JOIN active a ON a.repo = p.repo AND a.pack = p.pack
WHERE (p.repo, lower(replace(p.name, ' ', '_'))) NOT IN (SELECT (repo, lower(replace(name, ' ', '_'))) FROM fallback)
QUALIFY row_number() OVER (PARTITION BY p.repo, lower(replace(p.name, ' ', '_')) ORDER BY p.pack, p.family, p.name) = 1)""")
cte("seed", f"""SELECT repo, feature_id, name, description, conf, ord FROM calibrated
UNION ALL SELECT repo, {num('feat-', '(n + used)', 3)}, name, description, conf::BIGINT, n + used FROM added JOIN (SELECT repo, max(ord) AS used FROM fallback GROUP BY repo) USING (repo)""")
cte("groups", "SELECT * FROM (" + values(P.MERGE_GROUPS.items()) + ") v(member, shown)")


def best(src, key):
    return f"""SELECT s.repo, s.k AS key, s.name, s.description, s.conf, g.ord, g.members FROM (SELECT *, {key} AS k FROM {src}) s
 JOIN (SELECT repo, {key} AS k, min(ord) AS ord, sum(members)::BIGINT AS members FROM {src} GROUP BY ALL) g ON g.repo = s.repo AND g.k = s.k
 QUALIFY row_number() OVER (PARTITION BY s.repo, s.k ORDER BY s.conf DESC, s.ord) = 1"""


cte("seed1", "SELECT *, 1 AS members, (SELECT shown FROM groups WHERE member = " + snake("name") + ") AS grp FROM seed")
cte("deduped", best("seed1", "lower(name)"))
q("dedupe_features", "SELECT repo, name, description, conf, members FROM deduped")
cte("seed_merged", best("seed1", "coalesce('group:' || grp, lower(name))"))
q("merge_features", "SELECT repo, CASE WHEN starts_with(key, 'group:') THEN key[7:] ELSE name END AS name, description, conf, members FROM seed_merged")
cte("vfeats", f"""SELECT repo, {num('feat-', 'n', 3)} AS feature_id, key, nm AS name, description, conf, n AS ord, members FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY conf DESC, nm, key) AS n FROM (
 SELECT *, {snake("CASE WHEN starts_with(key, 'group:') THEN key[7:] ELSE name END")} AS nm FROM seed_merged))""")
q("validate_features", "SELECT repo, feature_id, name, description, conf, members FROM vfeats")
q("merge_members", "SELECT s.repo, v.feature_id, s.feature_id AS merged_id FROM seed1 s JOIN vfeats v ON v.repo = s.repo AND v.key = coalesce('group:' || grp, lower(s.name))")
q("prune_features", "SELECT repo, feature_id, name FROM vfeats WHERE conf >= 50")

cte("sig_in", "SELECT repo, family || '.' || signal AS signal_id, signal AS name, 'Uses ' || family || ' ' || signal || ' in python code' AS description, least(95, 35 + 7 * count(*)) AS conf FROM signals WHERE family IN ('middleware', 'orchestrator', 'stage') GROUP BY repo, family, signal")
cte("sig_files", "SELECT repo, family || '.' || signal AS signal_id, path FROM signals WHERE family IN ('middleware', 'stage')")
cte("sig_mods", """SELECT DISTINCT s.repo, s.signal_id, m.name AS module FROM sig_files s JOIN module_names m USING (repo, path)
UNION SELECT s.repo, s.signal_id, m.name FROM sig_in s JOIN modules_norm m ON m.repo = s.repo AND contains(replace(lower(m.name), '_', ' '), replace(lower(s.name), '_', ' '))""")
q("signal_modules", "SELECT * FROM sig_mods")
cte("sig_facts", "SELECT repo, signal_id, path AS fact FROM sig_files UNION SELECT repo, signal_id, module FROM sig_mods UNION SELECT repo, signal_id, item FROM sig_in, (VALUES ('Python'), ('cors'), ('zz top')) v(item) WHERE contains(lower(name), lower(item)) OR contains(lower(description), lower(item))")
cte("sig_ids", f"SELECT repo, signal_id, {num('feat-int-', 'row_number() OVER (PARTITION BY repo ORDER BY signal_id)', 3)} AS feature_id FROM sig_in")
cte("sig_proof", """SELECT repo, signal_id, 'file' AS kind, path AS item, 'signal' AS "by", path AS via FROM sig_files
UNION SELECT s.repo, s.signal_id, 'module', m.name, 'file', s.path FROM sig_files s JOIN module_names m USING (repo, path)
UNION SELECT s.repo, s.signal_id, 'module', m.name, 'name', s.name FROM sig_in s JOIN modules_norm m ON m.repo = s.repo AND contains(replace(lower(m.name), '_', ' '), replace(lower(s.name), '_', ' '))
UNION SELECT repo, signal_id, 'pool', item, 'mention', 'name' FROM sig_in, (VALUES ('Python'), ('cors'), ('zz top')) v(item) WHERE contains(lower(name), lower(item))
UNION SELECT repo, signal_id, 'pool', item, 'mention', 'description' FROM sig_in, (VALUES ('Python'), ('cors'), ('zz top')) v(item) WHERE contains(lower(description), lower(item))""")
q("interpretation_evidence", 'SELECT repo, feature_id, signal_id, kind, item, "by", via FROM sig_proof JOIN sig_ids USING (repo, signal_id)')
q("interpret_features", """SELECT repo, feature_id, signal_id, name, description, greatest(10, least(100, (conf * CASE WHEN m = 0 THEN 7 WHEN f = 1 THEN 9 ELSE 10 END + 5) // 10))::BIGINT AS conf, f AS n_evidence, m AS n_modules
FROM (SELECT s.*, i.feature_id, f, coalesce(m, 0) AS m FROM sig_in s JOIN sig_ids i USING (repo, signal_id) JOIN (SELECT repo, signal_id, count(*) f FROM sig_facts GROUP BY ALL) USING (repo, signal_id) LEFT JOIN (SELECT repo, signal_id, count(*) m FROM sig_mods GROUP BY ALL) USING (repo, signal_id))""")

cte("arche", "SELECT * FROM (" + values([(i, a, d, f, k) for i, (a, (ks, d, f)) in enumerate(P.ARCHETYPES.items()) for k in ks]) + ") v(o, archetype, display, fragment, kw)")
cte("arche_votes", "SELECT repo, o AS ord, archetype, count(*) AS votes, sum(conf)::BIGINT AS conf_sum FROM (SELECT DISTINCT v.repo, v.feature_id, v.conf, a.o, a.archetype FROM vfeats v JOIN arche a ON contains(v.name, a.kw)) GROUP BY ALL")
q("archetype_votes", "SELECT repo, ord::BIGINT AS ord, archetype, votes, conf_sum FROM arche_votes")
cte("arche_best", f"""SELECT r.repo, coalesce(a.archetype, '{P.NO_ARCHETYPE[0]}') AS archetype, coalesce(b.votes, 0) AS votes, coalesce(d.display, '{P.NO_ARCHETYPE[1]}') AS display, coalesce(d.fragment, '{P.NO_ARCHETYPE[2]}') AS fragment
FROM (SELECT DISTINCT repo FROM vfeats) r LEFT JOIN (SELECT * FROM arche_votes QUALIFY row_number() OVER (PARTITION BY repo ORDER BY votes DESC, conf_sum DESC, ord) = 1) b USING (repo)
LEFT JOIN (SELECT 0) z ON true LEFT JOIN (SELECT DISTINCT archetype FROM arche) a ON a.archetype = b.archetype AND b.votes >= 2 LEFT JOIN (SELECT DISTINCT archetype, display, fragment FROM arche) d ON d.archetype = a.archetype""")
q("archetype_vote", "SELECT * FROM arche_best")


def acro(e):
    toks = f"string_split(replace({e}, 'ci_cd', 'cicd'), '_')"
    pick = case([(f"upper(w) = '{k}'", f"'{v}'") for k, v in P.ACRONYMS.items()], "upper(w[1:1]) || lower(w[2:])")
    return f"array_to_string(list_transform({toks}, lambda w: {pick}), ' ')"


cte("cap_rows", "SELECT v.* FROM vfeats v JOIN (SELECT repo, max(conf) AS top FROM vfeats GROUP BY repo) USING (repo) WHERE conf >= CASE WHEN top >= 70 THEN 70 ELSE 50 END")
cte("caps", f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY conf DESC, name, feature_id) AS rank, {acro('name')} AS capability, conf FROM cap_rows")
q("capabilities", "SELECT * FROM caps")
q("product_summary", f"""SELECT a.repo, archetype AS product, concat_ws(' ', display || ' is a ' || fragment || ' comprising ' || n || ' functional capability/capabilities: ' || CASE WHEN n = 0 THEN 'no high-confidence capabilities detected' WHEN n <= 3 THEN lead ELSE lead || ', and ' || (n - 3) || ' more' END || '.',
 'Infrastructure includes ' || infra || '.', CASE WHEN tests THEN 'An automated test suite is present.' END) AS summary, n AS n_capabilities
FROM arche_best a LEFT JOIN (SELECT repo, count(*) n, string_agg(capability, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS lead FROM caps GROUP BY repo) USING (repo)
LEFT JOIN (SELECT repo, string_agg({acro('name')}, ', ' ORDER BY ord) AS infra FROM (SELECT * FROM vfeats WHERE conf >= 70 AND {anyword('name', P.INFRA_WORDS)} QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ord) <= 2) GROUP BY repo) i USING (repo)
LEFT JOIN (SELECT repo, bool_or({anyword('name', P.TEST_WORDS)}) AS tests FROM vfeats WHERE conf >= 70 GROUP BY repo) t USING (repo)""")
cte("ftext", "SELECT *, lower(name || ' ' || description) AS txt FROM vfeats")
cte("ptype", "SELECT repo, value FROM (SELECT repo, value, count(*) AS votes, min((ord, k)) AS seen FROM ftext, (" + values([(i, k, v) for i, (k, v) in enumerate(P.PRODUCT_WORDS)]) + ") w(k, kw, value) WHERE contains(txt, kw) GROUP BY repo, value) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY votes DESC, seen) = 1")
cte("pusers", "SELECT repo, string_agg(value, ', ' ORDER BY value) AS users FROM (SELECT DISTINCT repo, value FROM ftext, (" + values(P.USER_WORDS) + ") w(kw, value) WHERE contains(txt, kw)) GROUP BY repo")
cte("biz", f"""SELECT repo, coalesce(value, 'Web Software System') AS product_type, coalesce(users, 'General System Users') AS primary_users, 'Delivers ' || l[1] || CASE WHEN len(l) = 1 THEN '' WHEN len(l) = 2 THEN ' and ' || l[2] ELSE ', ' || l[2] || ', and ' || l[3] END || ' functionality.' AS core_value
FROM (SELECT repo, list({display('name')} ORDER BY conf DESC, ord) AS l FROM vfeats GROUP BY repo) LEFT JOIN ptype USING (repo) LEFT JOIN pusers USING (repo)""")
q("business_context", "SELECT * FROM biz")

# ---- requirements -------------------------------------------------------------------------
T = [(k, i, d, " ".join(a), a[0]) for k, rows in D.FR_TEMPLATES.items() for i, (d, a) in enumerate(rows)]
G = [(i, d, " ".join(a), a[0]) for i, (d, a) in enumerate(D.FR_GENERIC)]
cte("fr_known", "SELECT * FROM (" + values(T) + ") v(name, pos, d, acc, first)")
cte("fr_rows", f"""SELECT v.repo, v.name, v.ord, k.pos, k.d AS description, k.acc AS acceptance, k.first, v.conf FROM vfeats v JOIN fr_known k ON k.name = v.name
UNION ALL SELECT v.repo, v.name, v.ord, g.pos, replace(g.d, '{{name}}', {display('v.name')}), replace(g.acc, '{{name}}', {display('v.name')}), replace(g.first, '{{name}}', {display('v.name')}), v.conf FROM vfeats v, ({values(G)}) g(pos, d, acc, first) WHERE v.name NOT IN (SELECT name FROM fr_known)""")
cte("frs", "SELECT repo, 'FR-' || n AS req_id, name AS linked_feature, description, acceptance, first, n AS ord, ford FROM (SELECT repo, name, description, acceptance, first, ord AS ford, row_number() OVER (PARTITION BY repo ORDER BY ord, pos) AS n FROM fr_rows WHERE pos < CASE WHEN conf >= 80 THEN 3 WHEN conf >= 50 THEN 2 ELSE 1 END)")
q("functional_requirements", "SELECT repo, req_id, linked_feature, description, acceptance FROM frs")
NF = [(i, g, c, d) for i, (g, c, d) in enumerate([("base", c, d) for c, d in D.NFR_BASE] + [(g, c, d) for g, _, rows in D.NFR_BY_STACK for c, d in rows] + [("fill", c, d) for c, d in D.NFR_FILL])]
cte("nfr_rules", "SELECT * FROM (" + values(NF) + ") v(i, g, category, description)")
cte("nfr_on", "SELECT repo, 'base' AS g FROM repos UNION " + " UNION ".join(f"SELECT DISTINCT repo, '{g}' FROM labels WHERE {anyword('lower(label)', w)}" for g, w, _ in D.NFR_BY_STACK))
cte("nfr_some", "SELECT repo, i, category, description FROM nfr_on JOIN nfr_rules USING (g)")
cte("nfrs", "SELECT repo, 'NFR-' || n AS req_id, category, description, n AS ord FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY i) AS n FROM (SELECT * FROM nfr_some UNION ALL SELECT r.repo, i, category, description FROM nfr_rules, (SELECT repo FROM nfr_some GROUP BY repo HAVING count(*) < 6) r WHERE g = 'fill')) WHERE n <= 8")
q("nonfunctional_requirements", "SELECT * FROM nfrs")


def pathcat(e):
    return case([(f"contains(lower({e}), '{f}')", f"'{c}'") for f, c in P.CATEGORY_FRAGMENTS], "NULL")


q("feature_category", f"SELECT repo, module, coalesce(arg_min(c, path) FILTER (WHERE c IS NOT NULL), 'unknown') AS category FROM (SELECT repo, path, {topdir()} AS module, {pathcat('path')} AS c FROM files) GROUP BY ALL")
cte("mod_cat", f"SELECT m.repo, m.name, coalesce((SELECT arg_min({pathcat('path')}, path) FILTER (WHERE {pathcat('path')} IS NOT NULL) FROM module_names n WHERE n.repo = m.repo AND n.name = m.name), {pathcat('m.name')}, 'unknown') AS category, m.n_files FROM modules_norm m")
cte("payload", f"""SELECT repo, {num('feat-', 'n', 3)} AS feature_id, name, conf, n_files, category, n AS ord, module FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY kind, module) AS n FROM (
 SELECT repo, 0 AS kind, name AS module, array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS name, 100::BIGINT AS conf, n_files, category FROM mod_cat UNION ALL SELECT repo, 1, '', 'Structural Validation Quality', round(score * 100)::BIGINT, 1, 'core_pipeline' FROM validation))""")
q("payload_features", "SELECT repo, feature_id, name, conf, n_files, category FROM payload")
PRIO = "CASE WHEN conf < 40 AND category IN ('core_pipeline', 'api') THEN 'Medium' WHEN conf < 20 THEN 'Low' WHEN category IN ('core_pipeline', 'api') THEN 'High' WHEN category = 'feature_detection' THEN 'Medium' ELSE 'Low' END"
q("payload_requirements", f"SELECT repo, {num('REQ-', 'ord', 3)} AS req_id, feature_id, 'The system SHALL implement the ''' || name || ''' capability as evidenced by ' || n_files || ' source file(s) with a structural confidence of ' || (conf / 100)::VARCHAR || '.' AS description, {PRIO} AS priority FROM payload")
q("requirement_modules", f"SELECT DISTINCT p.repo, {num('REQ-', 'p.ord', 3)} AS req_id, m.module AS source_module FROM payload p JOIN module_names m ON m.repo = p.repo AND m.name = p.module WHERE p.module <> ''")
q("system_summary", "SELECT repo, repo || ': A system comprising ' || count(*) || ' structural module(s) (' || array_to_string(list_slice(list(name ORDER BY name), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ', and ' || (count(*) - 3) || ' more' ELSE '' END || ').' AS summary FROM modules_norm GROUP BY repo")
q("requirement_priorities", f"SELECT repo, feature_id, {PRIO.replace('conf', 'weak')} AS priority, CASE WHEN conf >= 80 THEN 'Must Have' WHEN conf >= 60 THEN 'Should Have' ELSE 'Could Have' END AS moscow FROM (SELECT *, conf - 30 AS weak, CASE ord % 4 WHEN 0 THEN 'core_pipeline' WHEN 1 THEN 'feature_detection' WHEN 2 THEN 'unknown' ELSE 'api' END AS category FROM seed)")
q("glossary", "SELECT repo, category AS term, 'seen in ' || min(path) AS definition FROM classified GROUP BY ALL")
q("requirement_confidence", "SELECT f.repo, req_id, coalesce(v.conf, 70) AS conf, coalesce(v.description, '') AS feature_text FROM frs f LEFT JOIN (SELECT * FROM vfeats WHERE ord % 2 = 1 QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY ord DESC) = 1) v ON v.repo = f.repo AND v.name = f.linked_feature")
cte("fr_full", f"SELECT f.repo, f.ord, f.ford, f.req_id, {display('f.linked_feature')} AS feature, v.description AS feature_text, f.description, f.first, CASE WHEN v.conf >= 80 THEN 'Must Have' WHEN v.conf >= 60 THEN 'Should Have' ELSE 'Could Have' END AS priority FROM frs f JOIN (SELECT * FROM vfeats QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY ord DESC) = 1) v ON v.repo = f.repo AND v.name = f.linked_feature")
q("requirement_table", "SELECT repo, req_id, feature, feature_text, description AS plain, description AS technical, 'Required for system operation.' AS impact, priority, first AS verified_by FROM fr_full")
q("enriched_requirements", "SELECT repo, req_id, feature, feature_text, CASE WHEN ord % 3 = 0 THEN 'Plain ' || req_id ELSE description END AS plain, description AS technical, CASE WHEN ord % 3 = 0 THEN 'High impact' ELSE 'Required for system operation.' END AS impact, priority, first AS verified_by FROM fr_full")
q("requirement_batches", "SELECT repo, req_id, (ord + 7) // 8 AS batch FROM frs")

# ---- documents --------------------------------------------------------------------------------
NL = "chr(10)"
EXTRA = {
    2: "CASE WHEN doc_id % 4 = 0 THEN 'It is ' || (" + "[" + ", ".join(lit(p) for p in D.CLARITY) + f"])[doc_id // 4 % {len(D.CLARITY)} + 1] || {NL} ELSE '' END",
    4: f"CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '| Role | Task |' || {NL} || '| End User | works |' || {NL} ELSE '| Role | Task |' || {NL} || '|---|---|' || {NL} || '| Billing Manager | pays |' || {NL} END",
    5: f"'FR-1 SHALL run' || {NL} || 'FR-12 later' || {NL} || CASE WHEN doc_id % 6 = 0 THEN 'FR-999 SHALL vanish' || {NL} ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Order Search' ELSE 'dashboard_report' END || {NL}",
    6: f"CASE WHEN doc_id % 5 = 0 THEN 'NFR-1 TBD' ELSE 'NFR-1 within 500 ms' END || {NL}",
    10: f"CASE doc_id % 4 WHEN 0 THEN '| Host | Docker image |' || {NL} WHEN 1 THEN 'Kubernetes and gRPC' || {NL} WHEN 2 THEN 'GDPR applies to the iOS client' || {NL} || {NL} || {NL} || {NL} ELSE '' END",
}
cte("docs", "SELECT 'doc' || doc_id AS doc_key, source AS repo, " + " || ".join(
    f"CASE WHEN (doc_id + {h}) % 17 = 0 THEN '' ELSE {lit(head)} || {NL} || {EXTRA.get(h, lit(''))} END || substring(text, {h - 1} * (length(text) // 16) + 1{', length(text) // 16' if h < len(D.HEADINGS) else ''}) || {NL}"
    for h, head in enumerate(D.HEADINGS, 1)) + " AS text FROM documents")


def ids(x):
    return f"regexp_extract_all(text, {lit(x)})"


cte("doc_ids", f"SELECT DISTINCT doc_key, repo, unnest(list_concat({ids(D.FR_ID)}, {ids(D.NFR_ID)})) AS req_id FROM docs")
q("requirement_ids", "SELECT * FROM doc_ids")
cte("heads16", "SELECT * FROM (" + values(enumerate(D.HEADINGS, 1)) + ") v(section, heading)")
cte("doc_pos", "SELECT doc_key, text, section, heading, strpos(text, heading) AS pos FROM docs, heads16")
cte("doc_next", "SELECT a.doc_key, a.section, a.heading, a.text, a.pos, arg_min(b.pos, b.section) AS stop FROM doc_pos a LEFT JOIN doc_pos b ON b.doc_key = a.doc_key AND b.section > a.section AND b.pos > a.pos WHERE a.pos > 0 GROUP BY ALL")
cte("doc_secs", r"SELECT doc_key, section, heading, len(list_filter(regexp_split_to_array(substring(text, pos + length(heading), coalesce(stop, length(text) + 1) - pos - length(heading)), '\s+'), lambda w: w <> '')) AS n_words FROM doc_next")
q("split_sections", "SELECT doc_key, section::BIGINT AS section, heading, n_words FROM doc_secs")
cte("phantoms", "SELECT doc_key, req_id FROM doc_ids d WHERE starts_with(req_id, 'FR-') AND NOT EXISTS (SELECT 1 FROM frs f WHERE f.repo = d.repo AND f.req_id = d.req_id)")
q("phantom_ids", "SELECT * FROM phantoms")
cte("feat_refs", f"SELECT doc_key, d.repo, v.name, {display('v.name')} AS shown, v.ord, contains(text, v.name) OR contains(text, {display('v.name')}) AS found FROM docs d JOIN vfeats v USING (repo)")
cte("id_refs", "SELECT doc_key, d.repo, f.req_id, f.linked_feature, f.ord AS ford, contains(text, f.req_id) AS found FROM docs d JOIN frs f USING (repo)")
q("missing_references", "SELECT doc_key, 'feature' AS kind, shown AS item FROM feat_refs WHERE NOT found UNION ALL SELECT doc_key, 'requirement', req_id FROM id_refs WHERE NOT found")
cte("terms", "SELECT * FROM (" + values([(i, t, f, rf"(?i)\b{t}s?\b") for i, (t, f) in enumerate(D.GROUNDING)]) + ") v(i, term, flag, regex)")
cte("told", "SELECT doc_key, repo, term, flag, value FROM docs JOIN evflags USING (repo) JOIN terms USING (flag) WHERE regexp_matches(text, regex)")
q("claims", "SELECT doc_key, term, flag FROM told WHERE NOT value")


def ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 10000 ELSE (({a}) * 20000 + ({b})) // (({b}) * 2) END"


def linesof(x, more=""):
    return f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {lit(x)}){more}))"


cte("sec4", "SELECT doc_key, pos, string_split(CASE WHEN strpos(tail[11:], chr(10) || '## ') > 0 THEN substring(tail, 1, strpos(tail[11:], chr(10) || '## ') + 9) ELSE tail END, chr(10)) AS ls FROM (SELECT doc_key, strpos(text, '## 4. Stakeholders') AS pos, substring(text, strpos(text, '## 4. Stakeholders')) AS tail FROM docs)")
cte("sec4rows", "SELECT doc_key, pos, list_filter(ls, lambda x: starts_with(trim(x), '|') AND NOT contains(x, '---') AND NOT contains(x, 'Role')) AS rs FROM sec4")
cte("stake", f"SELECT doc_key, CASE WHEN pos = 0 THEN 10000 WHEN len(rs) = 0 THEN 5000 WHEN len(list_filter(rs, lambda r: NOT list_contains({D.GENERIC_ROLES}, list_filter(list_transform(string_split(lower(r), '|'), lambda c: trim(c)), lambda c: c <> '')[1]))) > 0 THEN 10000 ELSE 6000 END AS stakeholders FROM sec4rows")
cte("tscores", f"""SELECT d.doc_key, d.repo, {ratio('(SELECT count(*) FROM doc_secs s WHERE s.doc_key = d.doc_key)', '16')} AS completeness,
 greatest(0, 10000 - 1000 * ({' + '.join(f"contains(lower(text), {lit(p)})::INT" for p in D.CLARITY)})) AS clarity, {ratio(linesof(D.FR_ID, f' AND regexp_matches(x, {lit(D.TESTABLE)})'), linesof(D.FR_ID))} AS testability,
 {ratio(linesof(D.NFR_ID, f' AND NOT regexp_matches(x, {lit(D.PLACEHOLDER)})'), linesof(D.NFR_ID))} AS nfr_specificity, k.stakeholders,
 {ratio('(SELECT count(*) FROM doc_secs s WHERE s.doc_key = d.doc_key AND n_words >= CASE WHEN section = 1 THEN 60 ELSE 30 END)', '(SELECT greatest(count(*), 1) FROM doc_secs s WHERE s.doc_key = d.doc_key)')} AS depth
FROM docs d JOIN stake k USING (doc_key)""")
q("text_scores", "SELECT doc_key, repo, " + ", ".join(f"{c}::BIGINT AS {c}" for c in "completeness clarity testability nfr_specificity stakeholders depth".split()) + " FROM tscores")
cte("trace", f"SELECT doc_key, {ratio('ok', 'n')} AS traceability, n - ok AS n_missing FROM (SELECT doc_key, count(*) AS n, count(*) FILTER (WHERE found) AS ok FROM (SELECT doc_key, found FROM feat_refs UNION ALL SELECT doc_key, found FROM id_refs) GROUP BY doc_key)")
q("score_traceability", "SELECT doc_key, traceability::BIGINT AS traceability, n_missing FROM trace")
cte("ghost", f"SELECT doc_key, {ratio('n - g', 'n')} AS phantom_ids, g AS n_phantom FROM (SELECT d.doc_key, count(*) AS n, count(p.req_id) AS g FROM doc_ids d LEFT JOIN phantoms p USING (doc_key, req_id) WHERE starts_with(d.req_id, 'FR-') GROUP BY d.doc_key)")
q("score_phantom_ids", "SELECT doc_key, phantom_ids::BIGINT AS phantom_ids, n_phantom FROM ghost")
cte("ground", f"SELECT d.doc_key, coalesce({ratio('n - g', 'n')}, 10000) AS grounding, coalesce(g, 0) AS n_ungrounded FROM docs d LEFT JOIN (SELECT doc_key, count(*) n, count(*) FILTER (WHERE NOT value) g FROM told GROUP BY doc_key) USING (doc_key)")
q("score_grounding", "SELECT doc_key, grounding::BIGINT AS grounding, n_ungrounded FROM ground")
NINE = "completeness traceability phantom_ids clarity testability nfr_specificity stakeholders depth grounding".split()
cte("nine", "SELECT s.doc_key, s.repo, completeness, coalesce(traceability, 10000) AS traceability, coalesce(phantom_ids, 10000) AS phantom_ids, clarity, testability, nfr_specificity, stakeholders, depth, grounding FROM tscores s LEFT JOIN trace USING (doc_key) LEFT JOIN ghost USING (doc_key) LEFT JOIN ground USING (doc_key)")
q("score_document", "SELECT doc_key, repo, " + ", ".join(f"{c} / 10000 AS {c}" for c in NINE) + f", sc / 10000 AS score, sc < 8500 OR grounding < 10000 OR phantom_ids < 10000 AS needs_revision FROM (SELECT *, (2 * ({' + '.join(NINE)}) + 9) // 18 AS sc FROM nine)")
IT = D.ISSUE_TEXTS


def told_issue(n, *parts):
    return f"{n}::BIGINT AS dimension, " + " || ".join(lit(x[1:]) if x.startswith("=") else x for x in parts) + " AS issue"


def bad_lines(rx, cond):
    return f"(SELECT doc_key, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {lit(rx)}) AND {cond})) AS line FROM docs)"


PHRASES = "(" + values([(i, p) for i, p in enumerate(D.CLARITY)]) + ") v(i, phrase)"
q("document_issues", "\nUNION ALL ".join([
    f"SELECT doc_key, {told_issue(1, '=' + IT['section'][0], 'heading', '=' + IT['section'][1])} FROM docs, heads16 WHERE NOT contains(text, heading)",
    f"SELECT doc_key, {told_issue(2, '=' + IT['feature'][0], 'shown', '=' + IT['feature'][1])} FROM feat_refs WHERE NOT found",
    f"SELECT doc_key, {told_issue(2, '=' + IT['requirement'][0], 'req_id', '=' + IT['requirement'][1])} FROM id_refs WHERE NOT found",
    f"SELECT doc_key, {told_issue(3, '=' + IT['phantom'][0], 'req_id', '=' + IT['phantom'][1])} FROM phantoms",
    f"SELECT doc_key, {told_issue(4, '=' + IT['phrase'][0], 'phrase', '=' + IT['phrase'][1])} FROM docs, {PHRASES} WHERE contains(lower(text), phrase)",
    f"SELECT doc_key, {told_issue(5, f'regexp_extract(line, {lit(D.FR_ID)})', '=' + IT['untestable'])} FROM {bad_lines(D.FR_ID, f'NOT regexp_matches(x, {lit(D.TESTABLE)})')}",
    f"SELECT doc_key, {told_issue(6, f'regexp_extract(line, {lit(D.NFR_ID)})', '=' + IT['placeholder'])} FROM {bad_lines(D.NFR_ID, f'regexp_matches(x, {lit(D.PLACEHOLDER)})')}",
    f"SELECT doc_key, 7, CASE stakeholders WHEN 5000 THEN {lit(IT['no_stakeholders'])} ELSE {lit(IT['generic_roles'])} END FROM stake WHERE stakeholders < 10000",
    f"SELECT doc_key, 8, CASE WHEN section = 1 THEN {lit(IT['summary'][0])} || n_words || {lit(IT['summary'][1])} ELSE {lit(IT['shallow'][0])} || heading[4:] || {lit(IT['shallow'][1])} || n_words || {lit(IT['shallow'][2])} END FROM doc_secs WHERE n_words < CASE WHEN section = 1 THEN 60 ELSE 30 END",
    f"SELECT doc_key, {told_issue(9, '=' + IT['ungrounded'][0], 'term', '=' + IT['ungrounded'][1], 'flag', '=' + IT['ungrounded'][2])} FROM told WHERE NOT value"]))


def esc(p):
    return "(?i)" + re.escape(p).replace(r"\ ", " ")


_t, _steps = "text", []
for i, (p, r) in enumerate(D.CLARITY.items()):
    cte(f"clear{i}", f"SELECT doc_key, regexp_replace(text, {lit(esc(p))}, {lit(r)}, 'g') AS text, n + regexp_matches(text, {lit(esc(p))})::INT AS n FROM " + (f"clear{i - 1}" if i else "(SELECT doc_key, text, 0 AS n FROM docs)"))
q("repair_clarity", f"SELECT doc_key, n::BIGINT AS n_replaced, md5(text) AS digest FROM clear{len(D.CLARITY) - 1}")
cte("bad_terms", "SELECT d.doc_key, d.text, coalesce(b, []) AS bad FROM docs d LEFT JOIN (SELECT doc_key, list(term) AS b FROM told WHERE NOT value GROUP BY doc_key) USING (doc_key)")
for i, (terms, changes) in enumerate(D.GROUNDING_REPAIR):
    e = "text"
    for x, r in changes:
        e = f"regexp_replace({e}, {lit(x)}, {lit(r)}, 'g')"
    cte(f"grounded{i}", f"SELECT doc_key, bad, CASE WHEN list_has_any(bad, {terms}) THEN {e} ELSE text END AS text FROM " + (f"grounded{i - 1}" if i else "bad_terms"))
q("repair_grounding", f"SELECT doc_key, md5(text) AS digest FROM grounded{len(D.GROUNDING_REPAIR) - 1}")
from corpuscope.operators.repair import _steps  # noqa: E402


def edits(k, kind, regex, new, src):
    head = f"SELECT doc_key, {k}::BIGINT AS step, '{kind}' AS kind, "
    if kind == "structure":
        return head + f"""1::BIGINT AS n, (length(text) + 1)::BIGINT AS "at", '' AS old, {lit(new)} AS new FROM {src} WHERE hit"""
    return head + f"""i::BIGINT AS n, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(o[1:i - 1], lambda x: length(x))), 0) + 1)::BIGINT AS "at", o[i] AS old, {lit(new)} AS new
 FROM (SELECT doc_key, o, b, unnest(range(1, len(o) + 1)) AS i FROM (SELECT doc_key, regexp_extract_all(text, {lit(regex)}) AS o, string_split_regex(text, {lit(regex)}) AS b FROM {src} WHERE hit))"""


_log = []
for k, (kind, cond, x, new) in enumerate(_steps(), 1):
    x = x.replace(chr(92) + "z", "$") if kind != "structure" else x
    hit = f"NOT contains(text, {lit(cond)})" if kind == "structure" else f"regexp_matches(text, {lit(x)})" + (f" AND list_has_any(bad, {cond})" if cond else "")
    cte(f"step{k}", f"SELECT doc_key, bad, text, {hit} AS hit FROM " + (f"done{k - 1}" if k > 1 else "bad_terms"))
    change = f"text || {lit(new)}" if kind == "structure" else f"regexp_replace(text, {lit(x)}, {lit(new)}, 'g')"
    cte(f"done{k}", f"SELECT doc_key, bad, CASE WHEN hit THEN {change} ELSE text END AS text FROM step{k}")
    _log.append(edits(k, kind, x, new, f"step{k}"))
q("revision_log", "\nUNION ALL ".join(_log))
q("replayed_documents", f"SELECT doc_key, md5(text) AS digest FROM done{len(_log)}")
STUBS = " || ".join(f"CASE WHEN contains(text, {lit(h)}) THEN '' ELSE chr(10) || {lit(h)} || chr(10) || {lit('*' + h[3:] + ' — content pending.*')} || chr(10) END" for h in D.STUB_HEADINGS)
q("repair_structure", f"SELECT doc_key, md5({stripped('regexp_replace(text || ' + STUBS + ', ' + lit(chr(92) + 'n{3,}') + ', chr(10) || chr(10), ' + lit('g') + ')')}) AS digest FROM docs")
q("traceability_appendix", f"""SELECT doc_key, ord::BIGINT AS ord, '| ' || shown || ' | ' || coalesce((SELECT string_agg(req_id, ', ' ORDER BY ord) FROM frs f WHERE f.repo = r.repo AND f.linked_feature = r.name), '—') || ' | — |' AS line FROM feat_refs r WHERE NOT found
UNION ALL SELECT doc_key, 1000000000000 + ford, '| ' || {display('linked_feature')} || ' | ' || req_id || ' | _(see FR section)_ |' FROM id_refs i WHERE NOT found AND NOT EXISTS (SELECT 1 FROM feat_refs r WHERE r.doc_key = i.doc_key AND r.name = i.linked_feature AND NOT r.found)""")

# ---- reports ------------------------------------------------------------------------------------
q("layer_inventory", "SELECT repo, " + case([(anyword("name", f), lit(x)) for x, f in P.LAYERS], "'Application Layer'") + f" AS layer, {display('name')} AS component, conf || '%' AS confidence, CASE WHEN {anyword('name', P.DOMAIN_WORDS)} THEN string_split(description, '.')[1] END AS domain_text FROM vfeats")
q("interface_table", f"""SELECT repo, n AS ord, 'endpoint' AS kind, concat_ws(' | ', handler, method, path, source_file) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY source_file, line, kind) AS n FROM endpoints) WHERE n <= 12
UNION ALL SELECT repo, n, 'rpc', concat_ws(' | ', service, rpc, request, response, source_file) FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY source_file, pos) AS n FROM rpcs WHERE repo NOT IN (SELECT repo FROM endpoints)) WHERE n <= 8
UNION ALL SELECT repo, 1, 'none', {lit(D.NO_INTERFACE)} FROM evid WHERE NOT has_http_api AND NOT has_grpc""")
cte("storage", f"SELECT repo, array_to_string(list_slice(list(name ORDER BY rank, manifest, pos), 1, 3), ', ') AS storage FROM (SELECT * FROM deps WHERE {BUCKETS} = 'database' QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY rank, manifest, pos) = 1) GROUP BY repo")
POL = [(k, i, t) for k, ts in D.DATA_POLICY.items() for i, t in enumerate(ts)]
q("data_rows", f"""SELECT repo, 0::BIGINT AS ord, 'Storage Paradigm' AS aspect, storage AS specification FROM storage JOIN evid USING (repo) WHERE has_database
UNION ALL SELECT repo, i, a, s FROM evid, ({values([(i, a, s) for i, (a, s) in enumerate(D.DATA_ROWS, 1)])}) v(i, a, s) WHERE has_database
UNION ALL SELECT repo, {len(D.DATA_ROWS) + 1} + i, 'Policy', t FROM evid, ({values(POL)}) v(k, i, t) WHERE has_database AND k = CASE WHEN has_gdpr_mention THEN 'gdpr' WHEN has_auth THEN 'auth' ELSE 'none' END
UNION ALL SELECT repo, i, a, s FROM evid, ({values([(0, 'Persistence', D.NO_DATA[0]), (1, 'Policy', D.NO_DATA[1])])}) v(i, a, s) WHERE NOT has_database""")
SUB = case([(f"contains(lower(label), {lit(f)})", lit(p)) for f, p in P.PURPOSE_SUBSTRING], lit(P.PURPOSE_DEFAULT))
TOK = case([(f"regexp_matches(lower(label), '(^|[^a-z]){f}([^a-z]|$)')", lit(p)) for f, p in P.PURPOSE_TOKEN], lit(P.PURPOSE_DEFAULT))
q("tech_purpose", f"SELECT repo, ord, label, {SUB} AS purpose, 'substring' AS mode FROM labels UNION ALL SELECT repo, ord, label, {TOK}, 'token' FROM labels")
q("stack_table", f"SELECT repo, ord, label, 'Confirmed' AS status, 'Latest Stable' AS version, {SUB} AS purpose FROM labels")
INFRA = {"mobile": [("Target Architecture", D.INFRA_MOBILE[0])] + D.INFRA_MOBILE[1], "desktop": [("Target Architecture", D.INFRA_DESKTOP[0])] + D.INFRA_DESKTOP[1],
         "k8s": [("Target Architecture", D.INFRA_K8S)] + D.INFRA_ROWS, "docker": [("Target Architecture", D.INFRA_DOCKER)] + D.INFRA_ROWS,
         "serverless": [("Target Architecture", D.INFRA_SERVERLESS)] + D.INFRA_ROWS, "none": [("Target Architecture", D.INFRA_NONE[0])] + D.INFRA_NONE[1]}
q("infra_rows", "SELECT repo, i::BIGINT AS ord, a AS aspect, s AS specification FROM evid, (" + values([(k, i, a, s) for k, rows in INFRA.items() for i, (a, s) in enumerate(rows)]) + ") v(k, i, a, s) WHERE k = CASE WHEN has_android OR has_ios THEN 'mobile' WHEN has_desktop THEN 'desktop' WHEN has_kubernetes THEN 'k8s' WHEN has_docker THEN 'docker' WHEN repo IN (SELECT repo FROM labels WHERE contains(lower(label), 'serverless') OR contains(lower(label), 'lambda')) THEN 'serverless' ELSE 'none' END")
q("risk_register", f"""SELECT repo, {num('R-', 'n', 2)} AS risk_id, risk, probability, impact, mitigation FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY kind, o) AS n FROM (
 SELECT repo, 0 AS kind, ord AS o, 'Ambiguous Implementation: ' || {display('name')} AS risk, 'Medium' AS probability, 'High' AS impact, 'Conduct code-level discovery' AS mitigation FROM vfeats WHERE conf < 60
 UNION ALL SELECT repo, 1, i, r, p, m, s FROM repos, ({values([(i, *r) for i, r in enumerate(D.RISKS)])}) v(i, r, p, m, s)))""")
CR = [(i, f or "", *r) for i, (f, *r) in enumerate(D.COMPLIANCE_ROWS)]
q("compliance_rows", f"""SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY i) - 1 AS ord, d AS domain, r AS requirement, s AS strategy FROM evid, ({values(CR)}) v(i, f, d, r, s)
WHERE (has_http_api OR has_auth OR has_gdpr_mention) AND (f = '' OR (f = 'has_auth' AND has_auth) OR (f = 'has_http_api' AND has_http_api) OR (f = 'has_gdpr_mention' AND has_gdpr_mention))
UNION ALL SELECT repo, 0, {', '.join(lit(x) for x in D.COMPLIANCE_NONE)} FROM evid WHERE NOT (has_http_api OR has_auth OR has_gdpr_mention)""")
cte("issue_rows", f"""SELECT r.repo, unnest(CASE WHEN len(l) = 0 THEN [{lit(D.ISSUE_NONE)}] ELSE l END) AS issue, unnest(range(1, greatest(len(l), 1) + 1)) AS n FROM (SELECT repo, list_filter([CASE WHEN n < 5 THEN {lit(D.ISSUE_FEW)} END, CASE WHEN low > 0 THEN low || {lit(D.ISSUE_LOW)} END,
 CASE WHEN repo NOT IN (SELECT repo FROM labels) THEN {lit(D.ISSUE_STACK)} END], lambda x: x IS NOT NULL) AS l FROM (SELECT repo, count(v.name) AS n, count(*) FILTER (WHERE v.conf < 60) AS low FROM repos LEFT JOIN vfeats v USING (repo) GROUP BY repo)) r""")
q("open_issues", f"SELECT repo, {num('OI-', 'n', 2)} AS issue_id, issue FROM issue_rows")
q("stakeholder_rows", f"""SELECT repo, i - 1 AS ord, role, 'Primary Actor' AS responsibility, 'High' AS impact, i <= 3 AS persona FROM (SELECT repo, unnest(string_split(primary_users, ', ')) AS role, unnest(range(1, len(string_split(primary_users, ', ')) + 1)) AS i FROM biz)
UNION ALL SELECT repo, len(string_split(primary_users, ', ')) + i, r, d, m, false FROM biz, ({values([(i, *r) for i, r in enumerate(D.FIXED_ROLES)])}) v(i, r, d, m)""")
GOALS = [(i, f"{g} | {a} | {m}" if a else None) for i, (g, a, m) in enumerate(D.GOALS)]
AUTH = "(SELECT bool_or(contains(lower(name), 'auth')) FROM vfeats x WHERE x.repo = r.repo)"
q("scope_and_goals", f"""SELECT r.repo, i::BIGINT AS ord, 'goal' AS kind, coalesce(t, CASE WHEN {AUTH} THEN {lit('G-03 | ' + ' | '.join(D.GOAL_AUTH))} ELSE {lit('G-03 | ' + ' | '.join(D.GOAL_NO_AUTH))} END) AS entry FROM (SELECT DISTINCT repo FROM vfeats) r, ({values(GOALS)}) v(i, t)
UNION ALL SELECT repo, i, 'out_of_scope', t FROM (SELECT DISTINCT repo FROM vfeats), ({values([(i, t) for i, t in enumerate(D.OUT_OF_SCOPE, len(D.GOALS))])}) v(i, t)
UNION ALL SELECT repo, n, 'in_scope', {display('name')} FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ord) AS n FROM vfeats WHERE conf >= 80) WHERE n <= 8
UNION ALL SELECT repo, i, 'in_scope', t FROM (SELECT repo FROM vfeats GROUP BY repo HAVING max(conf) < 80), ({values([(i, t) for i, t in enumerate(D.DEFAULT_SCOPE, 1)])}) v(i, t)""")
q("executive_rows", "SELECT repo, product_type, core_value, count(*) AS n_features, count(*) FILTER (WHERE conf >= 80) AS n_core, count(*) FILTER (WHERE conf < 60) AS n_review FROM biz JOIN vfeats USING (repo) GROUP BY ALL")
q("review_items", f"SELECT repo, n AS ord, {display('name')} AS item, description FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ord) AS n FROM vfeats WHERE conf < 60) WHERE n <= 3")

# ---- learning and numbering ------------------------------------------------------------------------
from .tables import CATEGORY  # noqa: E402

cte("reps", f"SELECT repo, ext, path, content FROM files WHERE ({CATEGORY}) = 'unknown' AND ext <> '' QUALIFY row_number() OVER (PARTITION BY repo, ext ORDER BY path) = 1")
q("representative_per_ext", "SELECT repo, ext, path FROM reps")
cte("unknown_snips", f"SELECT repo, ext, path, {stripped('content[1:800]')} AS snippet FROM reps WHERE ext NOT IN (SELECT ext FROM lang_ext)")
q("unknown_extensions", "SELECT repo, ext, path, md5(snippet) AS digest FROM unknown_snips WHERE snippet <> ''")
TOKENS = "(" + values(LANGUAGE_TOKENS) + ") v(regex, language, role, conf)"
q("infer_languages", f"SELECT ext, language, role, conf / 100 AS confidence, trim(regexp_extract(snippet, regex, 0)) AS evidence FROM unknown_snips, {TOKENS} WHERE regexp_matches(snippet, regex) QUALIFY row_number() OVER (PARTITION BY ext ORDER BY conf DESC, language DESC, role DESC, trim(regexp_extract(snippet, regex, 0)) DESC) = 1")
q("learned_languages", f"""SELECT DISTINCT ext, 'learned_py' AS language, 'backend' AS role, 0.9::DOUBLE AS confidence FROM files WHERE ext = '.py'
UNION ALL SELECT ext, language, role, conf / 100 FROM (SELECT ext, language, role, conf FROM (SELECT ext, {stripped('content[1:800]')} AS s FROM reps), {TOKENS} WHERE regexp_matches(s, regex) QUALIFY row_number() OVER (PARTITION BY ext ORDER BY conf DESC, language DESC, role DESC) = 1) WHERE conf >= 70 AND ext NOT IN (SELECT ext FROM lang_ext)""")
SN = snake("path")
q("text_functions", rf"""SELECT repo, path, {SN} AS snake, CASE WHEN {snake("ltrim(path, '.')")} = '' THEN 'unnamed' ELSE {snake("ltrim(path, '.')")} END AS module_snake, {display(SN)} AS display,
 array_to_string(list_transform(string_split({SN}, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS humanize, {acro(SN)} AS acronyms, len(ws) AS words,
 md5(CASE WHEN len(ws) <= 120 THEN content WHEN regexp_matches(head, '(?s)^(.+\.) ') THEN regexp_extract(head, '(?s)^(.+\.) ', 1) ELSE rtrim(head, ',;:') || '.' END) AS trimmed, path AS clean,
 md5({docstring('content')}) AS docstring, {uuid5('path')} AS uuid, md5(content)[1:8] AS fingerprint, (size % 100) || '%' AS percent
FROM (SELECT *, list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '') AS ws, array_to_string(list_slice(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''), 1, 120), ' ') AS head FROM files)""")
q("first_per_key", "SELECT repo, ext, min(path) AS path FROM files GROUP BY ALL")
q("top_k_per_group", "SELECT repo, path, size, n AS rank FROM (SELECT repo, path, size, row_number() OVER (PARTITION BY repo ORDER BY size DESC, path) AS n FROM files) WHERE n <= 5")
q("number_rows", f"SELECT repo, path, {num('ITEM-', 'n', 3)} AS id FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM files)")
q("batches", "SELECT repo, path, (row_number() OVER (PARTITION BY repo ORDER BY path) + 7) // 8 AS batch FROM files")
