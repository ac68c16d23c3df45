"""The corpus, its classification and the code and manifest finds, in SQL."""
from __future__ import annotations

from corpuscope.rules import languages as L, packs as P, signals as S
from corpuscope.rules.languages import REGISTRY
from corpuscope.sources.corpus import SNIPPETS

from .build import anyword, base, case, cte, ext, hasdir, inlist, lit, num, q, rx, snake, stem, stripped, title, topdir, values

cte("snippet_rows", "SELECT * FROM (" + values(SNIPPETS) + ") v(s, kind, dir, name, app, snip)")
cte("placed", """
SELECT d.doc_id AS i, d.doc_id % 20 AS r, d.source AS repo, d.text,
       CASE WHEN d.doc_id >= 40 AND NOT (CASE k.kind
            WHEN 0 THEN k.s = 0 OR (d.doc_id % 20 + k.s) % 3 <> 0 WHEN 1 THEN d.doc_id % 5 = 0 WHEN 2 THEN d.doc_id % 5 = 1
            WHEN 3 THEN d.doc_id % 5 = 2 WHEN 4 THEN d.doc_id % 4 = 1 WHEN 5 THEN d.doc_id % 2 = 0
            WHEN 6 THEN d.doc_id % 20 % 3 <> 0 WHEN 7 THEN d.doc_id % 2 = 1 ELSE d.doc_id % 20 % 7 = 0 END)
       THEN 0 ELSE k.s END AS s
FROM documents d JOIN snippet_rows k ON k.s = (7 * d.doc_id + d.doc_id // 20) % 31""")
cte("rawfiles", """
SELECT p.repo,
  CASE WHEN i < 20 AND r IN (4, 14) THEN 'main.py' WHEN i < 20 AND r % 5 = 4 THEN 'notes.txt' WHEN i < 20 THEN 'README.md'
       WHEN i < 40 AND r = 19 THEN 'todo.txt' WHEN i < 40 AND r % 2 = 0 THEN 'package.json' WHEN i < 40 THEN 'pyproject.toml'
       ELSE k.dir || '/d' || i || '/' || k.name END AS path,
  CASE WHEN i < 20 AND r IN (4, 14) THEN '\"\"\"Fixture service.\"\"\"' || chr(10) WHEN i < 20 AND r % 5 = 4 THEN text
       WHEN i < 20 THEN CASE WHEN r % 6 = 0 THEN 'Personal data follows GDPR.' || chr(10) ELSE '' END || text
       WHEN i < 40 AND r = 19 THEN text
       WHEN i < 40 AND r % 2 = 0 THEN '{"name": "app' || r || '", "description": "fixture", "dependencies": {"react": "^18.2.0"}}'
       WHEN i < 40 THEN 'name = "app' || r || '"' || chr(10) || 'description = "fixture"' || chr(10)
       ELSE k.snip || CASE WHEN k.app THEN text ELSE '' END END AS content
FROM placed p JOIN snippet_rows k USING (s)""".replace('\\"', '"'))
cte("allfiles", """SELECT repo, path, content FROM rawfiles UNION ALL
SELECT p.repo, CASE WHEN i BETWEEN 20 AND 39 THEN 'text' || i || '.txt' ELSE k.dir || '/d' || i || '/text.txt' END, text
FROM placed p JOIN snippet_rows k USING (s) WHERE CASE WHEN i < 20 THEN r IN (4, 14) WHEN i < 40 THEN r <> 19 ELSE NOT k.app END""")
cte("files", f"SELECT repo, path, {ext()} AS ext, strlen(content) AS size, content FROM allfiles")
cte("bare", "SELECT page_id, html, regexp_replace(url, '[?#].*$', '') AS u FROM pages")
cte("webparts", "SELECT page_id, html, regexp_extract(u, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_replace(u, '^[a-z]+://[^/]+/?', ''), '/+$', '') AS folder FROM bare")
cte("web", "SELECT host AS repo, CASE WHEN folder = '' THEN '' ELSE folder || '/' END || 'd' || page_id || '/index.html' AS path, '.html' AS ext, strlen(html) AS size, html AS content FROM webparts")
cte("both_files", "SELECT * FROM files UNION ALL SELECT * FROM web")
cte("scan", f"SELECT * FROM files WHERE NOT {hasdir(L.IGNORE_DIRS)} AND NOT {inlist('ext', L.BINARY_EXTS)}")
cte("lang_ext", "SELECT * FROM (" + values(REGISTRY.lang_ext) + ") v(ext, language, role, tier)")


def role(e="ext"):
    return case([(inlist(e, L.CONFIG_EXTS), "'config'"), (inlist(e, L.DOC_EXTS), "'docs'"), (inlist(e, L.BINARY_EXTS), "'binary'"),
                 (f"{e} IN (SELECT ext FROM lang_ext WHERE role = 'backend')", "'backend'"),
                 (f"{e} IN (SELECT ext FROM lang_ext WHERE role = 'frontend')", "'frontend'")], "'unknown'")


def _ladder():
    name, among = f"lower({base()})", lambda ns: f"list_has_any(string_split(lower(path), '/'), [{', '.join(map(lit, ns))}])"
    steps = [(inlist(name, REGISTRY.entry_points), "entry_point", 1.0), (f"({role()}) = 'config'", "config", 0.9),
             (anyword(name, L.CONFIG_NAME_WORDS), "config", 0.8), (among(L.CONFIG_DIRS), "config", 0.7)]
    for cat, dirs, words in L.CATEGORY_LADDER:
        steps.append((among(dirs), cat, 0.9))
        if cat == "component":
            steps.append((f"({role()}) = 'frontend'", cat, 0.8))
        steps.append((anyword(name, words), cat, 0.8))
    return steps


CATEGORY = case([(c, lit(v)) for c, v, _ in _ladder()], "'unknown'")
CONFIDENCE = "CAST(" + case([(c, s) for c, _, s in _ladder()], "0.0") + " AS DOUBLE)"
cte("classified", f"SELECT *, {CATEGORY} AS category, {CONFIDENCE} AS confidence FROM scan")
cte("linelist", r"SELECT repo, path, category, regexp_extract_all(content, '[^\n]*\n|[^\n]+') AS ls FROM classified")
cte("ln", "SELECT repo, path, category, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM linelist")
cte("fold", """RECURSIVE fold(repo, path, n, no, held) AS (
  SELECT repo, path, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM linelist WHERE len(ls) > 0
  UNION ALL
  SELECT f.repo, f.path, l.n, CASE WHEN f.held >= 3200 THEN f.no + 1 ELSE f.no END,
         CASE WHEN f.held >= 3200 THEN 0 ELSE f.held END + length(l.line)
  FROM fold f JOIN ln l ON l.repo = f.repo AND l.path = f.path AND l.n = f.n + 1)""")
cte("chunks", """SELECT l.repo, l.path, l.category, f.no AS chunk_no, string_agg(l.line, '' ORDER BY l.n) AS content
FROM ln l JOIN fold f ON f.repo = l.repo AND f.path = l.path AND f.n = l.n GROUP BY ALL""")
cte("members", f"SELECT DISTINCT repo, {topdir()} AS module, path FROM classified WHERE length(content) > 0")
cte("module_names", f"SELECT DISTINCT repo, path, module, CASE WHEN {snake('ltrim(module, ' + lit('.') + ')')} = '' THEN 'unnamed' ELSE {snake('ltrim(module, ' + lit('.') + ')')} END AS name FROM members WHERE NOT {inlist('module', P.MODULE_NOISE)} AND NOT starts_with(module, '.')")
UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({n}))"


def uuid5(n):
    h = UUID.format(n=n)
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || {h}[18:20] || '-' || {h}[21:32]"


cte("modules_norm", f"SELECT repo, {uuid5('name')} AS module_id, name, count(DISTINCT path) AS n_files, CAST(1.0 AS DOUBLE) AS confidence FROM module_names GROUP BY repo, name")
cte("repos", "SELECT DISTINCT repo FROM scan")


def validate(mods, repos):
    core = anyword("name", P.CORE_MODULE_WORDS)
    return f"""SELECT r.repo, CASE WHEN n IS NULL THEN 0 WHEN core THEN 100 ELSE 70 END / 100 AS score,
  coalesce(core, false) AS valid, CASE WHEN n IS NULL OR NOT core THEN 1 ELSE 0 END::BIGINT AS n_issues
FROM (SELECT DISTINCT repo FROM {repos}) r LEFT JOIN (SELECT repo, count(*) n, bool_or({core}) core FROM {mods} GROUP BY repo) USING (repo)"""


cte("validation", validate("modules_norm", "scan"))
cte("web_modules", f"SELECT DISTINCT repo, {snake(topdir())} AS name FROM web WHERE NOT {inlist(topdir(), P.MODULE_NOISE)}")

# scans and classification
q("module_overview", """SELECT m.repo, m.name, m.n_files, c.n_chunks, v.score, v.valid FROM modules_norm m JOIN validation v USING (repo)
JOIN (SELECT repo, name, count(*) AS n_chunks FROM module_names JOIN chunks USING (repo, path) GROUP BY repo, name) c USING (repo, name)""")
q("scan_files", f"SELECT repo, path, ext, size, md5(content) AS digest FROM files WHERE NOT {hasdir(L.IGNORE_DIRS)}")
q("drop_binary", f"SELECT repo, ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE NOT {inlist('ext', L.BINARY_EXTS)} GROUP BY ALL")


def pack_where(pack):
    return f"({inlist('ext', S.PACK_EXTS[pack])} AND NOT {hasdir(S.SKIP_DIRS[pack])})"


q("read_with_limits", f"SELECT repo, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE {pack_where('web')} GROUP BY repo")
q("path_parts", f"SELECT repo, path, {base()} AS name, {stem()} AS stem, {ext()} AS ext, len(string_split(path, '/')) AS depth, array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '/') AS dir FROM both_files")
q("language_of", "SELECT repo, coalesce(language, 'unknown') AS language, count(*) AS n FROM files LEFT JOIN lang_ext USING (ext) GROUP BY ALL")
q("role_of", f"SELECT repo, {role()} AS role, count(*) AS n FROM both_files GROUP BY ALL")
q("entry_points", f"SELECT repo, path FROM files WHERE {inlist('lower(' + base() + ')', REGISTRY.entry_points)}")
q("build_files", f"SELECT repo, path FROM files WHERE {inlist('lower(' + base() + ')', REGISTRY.build_files)}")
q("describe_ext", "SELECT DISTINCT f.ext, language, role, tier FROM files f LEFT JOIN lang_ext USING (ext)")
q("language_names", "SELECT DISTINCT language FROM (SELECT language FROM (" + values([(n,) for n, *_ in REGISTRY.languages]) + ") v(language) UNION SELECT 'learned_abcml' FROM files WHERE ext = '.abcml')")
q("inferred_tier", "SELECT ext, coalesce(language, CASE WHEN ext = '.abcml' THEN 'learned_abcml' ELSE 'unknown' END) AS language, count(*) AS n FROM files LEFT JOIN lang_ext USING (ext) GROUP BY ALL")
q("classify_files", f"SELECT repo, path, {CATEGORY} AS category, {CONFIDENCE} AS confidence FROM files")
q("category_counts", f"SELECT repo, {CATEGORY} AS category, count(*) AS n FROM both_files GROUP BY ALL")
q("structural_role", "SELECT DISTINCT * FROM (SELECT repo, " + case([(hasdir(d, True), lit(r)) for r, d in L.STRUCTURE_DIRS.items()], "NULL") + f" AS role, {base()} AS name FROM both_files WHERE ext IN (SELECT ext FROM lang_ext) AND NOT {inlist('ext', L.BINARY_EXTS)} AND NOT {hasdir(L.STRUCTURE_SKIP_DIRS)}) WHERE role IS NOT NULL")
q("negative_paths", f"SELECT repo, path FROM files WHERE {rx('path', L.NEGATIVE_PATH)}")
q("business_paths", f"SELECT repo, count(*) FILTER (WHERE {rx('path', L.BUSINESS_PATH)}) AS business, count(*) AS n FROM both_files GROUP BY repo")
BUCKET = f"CASE WHEN ({role()}) IN ('frontend', 'backend', 'config', 'docs') THEN ({role()}) ELSE 'unknown' END"
cte("role_rows", f"SELECT repo, path, {BUCKET} AS role FROM files")
cte("role_rows_both", f"SELECT repo, path, {BUCKET} AS role FROM both_files")
q("role_files", "SELECT repo, role, path FROM role_rows")
q("role_buckets", "SELECT repo, " + ", ".join(f"count(*) FILTER (WHERE role = '{r}') AS {r}" for r in ("frontend", "backend", "config", "docs", "unknown")) + " FROM role_rows_both GROUP BY repo")
q("directory_rollup", """SELECT repo, array_to_string(list_slice(ps, 1, k), '/') AS dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes
FROM (SELECT repo, size, string_split(path, '/') AS ps, unnest(range(1, len(string_split(path, '/')))) AS k FROM both_files) GROUP BY ALL""")
q("scan_with_category", f"SELECT repo, path, ext, size, CASE WHEN ext = '.md' THEN 'unknown' ELSE {CATEGORY} END AS category, CASE WHEN ext = '.md' THEN 0.0::DOUBLE ELSE {CONFIDENCE} END AS confidence FROM files")
q("payload_files", "SELECT repo, path, ext, size, category, confidence FROM classified")
q("payload_records", """SELECT repo, '{"path":' || to_json(path) || ',"ext":' || to_json(ext) || ',"size":' || size || ',"category":"' || category || '","confidence":' || confidence || '}' AS record FROM classified""")
q("final_payload", """SELECT repo, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE category = 'unknown') AS n_unknown,
 any_value(c.n) AS n_chunks, any_value(m.n) AS n_modules, any_value(score) AS score, any_value(valid) AS valid, any_value(n_issues) AS n_issues
FROM classified JOIN (SELECT repo, count(*) n FROM chunks GROUP BY repo) c USING (repo) JOIN (SELECT repo, count(*) n FROM modules_norm GROUP BY repo) m USING (repo)
JOIN validation USING (repo) GROUP BY repo""")

# chunks and pieces
q("chunk_lines", "SELECT repo, path, category, chunk_no, path || '_' || chunk_no || '_' || md5(content)[1:8] AS chunk_id, length(content) AS chars FROM chunks")
q("snippet_of", f"SELECT repo, path, ext, md5(s) AS digest FROM (SELECT *, {stripped('content[1:800]')} AS s FROM files) WHERE s <> ''")
cte("heads", f"""SELECT repo, path, chunk_no, {stripped("replace(content[1:600], chr(10), ' ')")} AS content, {rx('path', L.BUSINESS_PATH)} AS p1,
 category IN ('route', 'entry_point') OR {anyword('lower(path)', S.SNIPPET_ENTRY_NAMES)} AS p2, {anyword('lower(path)', S.SNIPPET_MODEL_DIRS)} AS p3 FROM chunks""")
cte("head_files", "SELECT repo, path, arg_min(content, chunk_no) AS content, bool_or(p1) p1, bool_or(p2) p2, bool_or(p3) p3 FROM heads WHERE content <> '' AND (p1 OR p2 OR p3) GROUP BY repo, path")
cte("snip1", "SELECT repo, path, content, 'business_logic' AS reason FROM head_files WHERE p1 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 6")
cte("snip2", "SELECT repo, path, content, 'entry_point' AS reason FROM head_files WHERE p2 AND (repo, path) NOT IN (SELECT (repo, path) FROM snip1) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 8 - (SELECT count(*) FROM snip1 s WHERE s.repo = head_files.repo)")
cte("snip12", "SELECT * FROM snip1 UNION ALL SELECT * FROM snip2")
cte("snip3", "SELECT repo, path, content, 'data_model' AS reason FROM head_files WHERE p3 AND (repo, path) NOT IN (SELECT (repo, path) FROM snip12) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 10 - (SELECT count(*) FROM snip12 s WHERE s.repo = head_files.repo)")
q("key_snippets", "SELECT repo, path, reason, content FROM (SELECT * FROM snip12 UNION ALL SELECT * FROM snip3)")
q("model_candidate_files", f"""SELECT repo, path, priority::BIGINT AS priority, row_number() OVER (PARTITION BY repo ORDER BY priority, path) AS rank FROM (
 SELECT repo, path, CASE WHEN contains(lower(path), 'model') OR contains(lower(path), 'entity') THEN 0 WHEN contains(lower(path), 'schema') OR contains(lower(path), 'dto') THEN 1 ELSE 2 END AS priority
 FROM files WHERE {inlist('ext', S.MODEL_EXTS)} AND NOT {anyword('lower(path)', S.MODEL_PATH_SKIP)}
 AND ({anyword('content', S.MODEL_WORDS)} OR contains({base()}, 'message ') OR {anyword('lower(content)', S.MODEL_WORDS_LOWER)})) QUALIFY rank <= 15""")
cte("kw_files", " UNION ALL ".join(f"SELECT repo, path, {lit(n)} AS feature FROM files WHERE {anyword('lower(path)', k)} OR {anyword('lower(content)', k)}" for n, k in S.KEYWORD_FEATURES))
q("keyword_files", "SELECT repo, path, feature FROM kw_files")
q("keyword_features", "SELECT repo, feature, count(*) AS n_files, least(100, count(*) * 20) / 100 AS confidence FROM kw_files GROUP BY ALL")
q("coarse_modules", "SELECT repo, concat_ws(',', " + ", ".join(f"CASE WHEN bool_or(role = '{r}') THEN '{t}' END" for r, t in [("frontend", "Frontend UI"), ("backend", "Backend Services"), ("config", "Configuration Management"), ("docs", "Documentation")]) + ") AS modules FROM role_rows GROUP BY repo")
q("doc_gaps", """SELECT repo, concat_ws(';', CASE WHEN NOT readme THEN 'Missing or empty README.md' END, CASE WHEN readme AND NOT docs THEN 'Minimal documentation (only README found)' END,
 CASE WHEN NOT tests THEN 'No obvious test files found' END) AS gaps FROM (SELECT r.repo, bool_or(lower(r.path) = 'readme.md' AND f.content <> '') readme, bool_or(role = 'docs') docs,
 bool_or(role IN ('frontend', 'backend') AND contains(lower(r.path), 'test')) tests FROM role_rows r JOIN files f USING (repo, path) GROUP BY r.repo)""")
q("modules", f"SELECT repo, {topdir()} AS module, count(DISTINCT path) AS n_files, count(*) AS n_chunks FROM chunks GROUP BY ALL")
q("module_files", "SELECT * FROM members")
q("normalize_modules", "SELECT * FROM modules_norm")
q("validate_modules", "SELECT * FROM validation")
q("validate_web_modules", validate("web_modules", "web"))
q("validation_issues", f"SELECT repo, CASE WHEN core IS NULL THEN 'No modules found in the context.' ELSE 'Missing core application structure (e.g., no module named src, app, lib, backend, or frontend).' END AS issue FROM (SELECT DISTINCT repo FROM web) LEFT JOIN (SELECT repo, bool_or({anyword('name', P.CORE_MODULE_WORDS)}) core FROM web_modules GROUP BY repo) USING (repo) WHERE core IS NOT TRUE")

# signals
cte("notebooks", """SELECT repo, path, ext, size, (SELECT string_agg(array_to_string(CAST(c->'source' AS VARCHAR[]), chr(10)), chr(10)) FROM (SELECT unnest(CAST(CAST(content AS JSON)->'cells' AS JSON[])) AS c) WHERE c->>'cell_type' = 'code') AS content
FROM files WHERE ext = '.ipynb' AND json_valid(content)""")
q("notebook_code", "SELECT repo, path, content FROM notebooks")
cte("ml_files", f"SELECT * FROM (SELECT repo, path, ext, size, content FROM notebooks UNION ALL SELECT repo, path, ext, size, content FROM files WHERE ext <> '.ipynb') WHERE {pack_where('ml')}")
cte("signal_rules", "SELECT * FROM (" + values([(r.family, r.signal, r.regex) for r in S.presence_rules()]) + ") v(family, signal, regex)")
cte("signals", " UNION ALL ".join(
    f"SELECT DISTINCT f.repo, f.path, s.family, s.signal FROM {src} f, signal_rules s WHERE {inlist('s.family', fams)}{where} AND regexp_matches(f.content, s.regex)"
    for src, fams, where in [("files", ["middleware", "auth"], f" AND {pack_where('web')}"),
                             ("files", ["orchestrator", "source", "quality"], f" AND {pack_where('data')}"),
                             ("ml_files", ["stage", "model", "framework", "metric"], "")]))
q("presence_signals", "SELECT * FROM signals")
cte("sig_counts", "SELECT repo, family, signal, count(*) AS n_files FROM signals GROUP BY ALL")
for name, fam in [("middleware_signals", "middleware"), ("orchestrators", "orchestrator"), ("data_sources", "source"), ("data_quality_checks", "quality"), ("ml_frameworks", "framework")]:
    q(name, f"SELECT repo, signal, n_files FROM sig_counts WHERE family = '{fam}'")
q("ml_stages", "SELECT repo, signal, n_files, least(90, 60 + 10 * n_files) / 100 AS confidence FROM sig_counts WHERE family = 'stage'")
q("model_types", "SELECT repo, signal, n_files, least(90, 70 + 5 * n_files) / 100 AS confidence FROM sig_counts WHERE family = 'model'")
q("eval_metrics", "SELECT repo, path, signal, row_number() OVER (PARTITION BY repo, signal ORDER BY path) AS rank FROM signals WHERE family = 'metric' QUALIFY rank <= 3")
q("apply_rules", "SELECT repo, 'user' AS family, signal, count(*) AS n_files FROM files, (" + values([("import", r"(?m)^(?:import|from) \w+", ".py"), ("html", r"(?i)<html", None), ("digits", r"\d{4}", None), ("question", r"\?", None)]) + ") v(signal, regex, for_ext) WHERE (for_ext IS NULL OR ext = for_ext) AND regexp_matches(content, regex) GROUP BY ALL")
cte("defect_rules", "SELECT * FROM (" + values([(i, *r) for i, r in enumerate(S.DEFECT_RULES)]) + ") v(rule, regex, type, severity, message)")
cte("defects", f"""SELECT repo, path, n AS line, type, severity, CASE WHEN contains(message, '{{detail}}') THEN replace(message, '{{detail}}', trim(regexp_extract(text, regex, 1))) ELSE message END AS description, rule
FROM (SELECT repo, path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n,
 contains(lower(path), '/test/') OR contains(lower({stem()}), 'test') AS is_test FROM files
 WHERE ({inlist('ext', S.DEFECT_EXTS)} OR {inlist('lower(' + base() + ')', S.DEFECT_NAMES)}) AND NOT list_has_any(string_split(path, '/'), [{', '.join(map(lit, S.DEFECT_SKIP_DIRS))}])), defect_rules
WHERE regexp_matches(text, regex) AND NOT (type = 'blocking_call' AND is_test)""")
q("scan_defects", "SELECT repo, path, line, type, severity, description FROM defects")
q("sort_defects", f"SELECT repo, {num('BUG-', 'n', 2)} AS defect_id, type, path, line FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, path, line, rule) AS n FROM defects)")
cte("route_hits", " UNION ALL ".join(
    f"SELECT repo, path AS source_file, {i} AS pat, 0 AS kind, upper(unnest(regexp_extract_all(content, {lit(x)}, 1))) AS method, unnest(regexp_extract_all(content, {lit(x)}, 2)) AS route, unnest(range(len(regexp_extract_all(content, {lit(x)}, 1)))) AS pos FROM files WHERE {pack_where('web')}"
    for i, (_, x) in enumerate(S.ROUTE_REGEXES)) + f" UNION ALL SELECT repo, path, 9, 1, 'gRPC', unnest(regexp_extract_all(content, {lit(S.GRPC_NAME)}, 1)), unnest(range(len(regexp_extract_all(content, {lit(S.GRPC_NAME)}, 1)))) FROM files WHERE {pack_where('web')}")
cte("contracts", f"SELECT repo, method, route AS path, source_file, kind, pat, pos FROM route_hits WHERE kind = 1 OR NOT {inlist('rtrim(route, ' + lit('/') + ')', S.BOILERPLATE_PATHS)} QUALIFY row_number() OVER (PARTITION BY repo, method, route ORDER BY kind, source_file, pat, pos) = 1")
q("http_contracts", "SELECT repo, method, path, source_file FROM contracts")
AUTH_TYPES = list(dict.fromkeys(t for t, _ in S.AUTH_RULES))
cte("auth_hits", " UNION ALL ".join(
    f"SELECT repo, path, {lit(t)} AS auth_type, {i} AS ord, " + " + ".join(f"least(3, len(regexp_extract_all(content, {lit(x)})))" for n, x in S.AUTH_RULES if n == t) + f" AS hits FROM files WHERE {pack_where('web')}"
    for i, t in enumerate(AUTH_TYPES)))
cte("auth_types", "SELECT repo, auth_type, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS n_files, min((path, ord)) AS seen FROM auth_hits WHERE hits > 0 GROUP BY repo, auth_type")
cte("auth", "SELECT repo, auth_type, hits, n_files, CASE WHEN row_number() OVER (PARTITION BY repo ORDER BY hits DESC, seen) = 1 THEN 'dominant' WHEN hits >= 2 THEN 'secondary' ELSE 'weak' END AS standing FROM auth_types")
q("auth_signals", "SELECT * FROM auth")
cte("pipe_hits", f"""SELECT repo, path AS source_file, unnest(regexp_extract_all(content, {lit(S.AIRFLOW_DAG)}, 1)) AS name, 'airflow_dag' AS type FROM files WHERE {pack_where('data')}
UNION ALL SELECT repo, path, unnest(regexp_extract_all(content, {lit(S.LUIGI)}, 1)), 'luigi_task' FROM files WHERE {pack_where('data')}
UNION ALL SELECT repo, path, {stem()}, 'dbt_model' FROM files WHERE {pack_where('data')} AND ({rx('content', S.DBT_REF)} OR {rx('content', S.DBT_SOURCE)})
UNION ALL SELECT repo, path, {stem()}, 'dagster_asset' FROM files WHERE {pack_where('data')} AND {rx('content', S.DAGSTER)}
UNION ALL SELECT repo, path, {stem()}, 'prefect_flow' FROM files WHERE {pack_where('data')} AND {rx('content', S.PREFECT)}""")
cte("pipelines", "SELECT repo, name, type, min(source_file) AS source_file FROM pipe_hits GROUP BY ALL")
q("pipeline_definitions", "SELECT * FROM pipelines")
cte("screens", "SELECT repo, name, type, min(path) AS source_file FROM (" + " UNION ALL ".join(
    f"SELECT repo, path, unnest(regexp_extract_all(content, {lit(x)}, 1)) AS name, {lit(k)} AS type FROM files WHERE {pack_where('mobile')}" + (f" AND {inlist('ext', e)}" if e else "") for k, x, e in S.SCREEN_RULES) + ") GROUP BY ALL")
q("app_screens", "SELECT * FROM screens")
cte("perms", " UNION ".join(f"SELECT repo, {lit(p)} AS platform, unnest(regexp_extract_all(content, {lit(x)}, 1)) AS permission FROM files WHERE {pack_where('mobile')}" for p, x in [("android", S.ANDROID_PERMISSION), ("ios", S.IOS_PERMISSION)]))
q("device_permissions", "SELECT * FROM perms")
cte("mobile_marks", rf"""SELECT DISTINCT repo, platform FROM (SELECT repo, unnest([CASE WHEN {base()} = 'AndroidManifest.xml' OR starts_with({base()}, 'build.gradle') THEN 'android' END,
 CASE WHEN regexp_matches(path, '(\.xcodeproj|\.xcworkspace)(/|$)') OR {base()} = 'Podfile' THEN 'ios' END, CASE WHEN path = 'pubspec.yaml' THEN 'flutter' END,
 CASE WHEN path IN ('app.json', 'metro.config.js') THEN 'react_native' END]) AS platform FROM files) WHERE platform IS NOT NULL""")
q("mobile_platforms", "SELECT * FROM mobile_marks")
LB = f"lower({base()})"
q("desktop_ui_signals", rf"""SELECT repo, path, kind, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS text FROM (SELECT repo, path, unnest([
 CASE WHEN (starts_with({LB}, 'readme') OR ends_with({LB}, '.md')) AND regexp_matches(content, '(?i)powerbuilder|appeon') THEN 'readme' END,
 CASE WHEN ends_with({LB}, '.xml') AND (contains({LB}, 'ribbon') OR regexp_matches(content, '(?i)ribbon')) THEN 'ribbon_xml' END,
 CASE WHEN regexp_matches({LB}, '(\.srp|\.sru|\.pbl|\.pbd|\.pbr|\.pb|\.w)$') OR regexp_matches(content, '(?i)\bPowerBuilder\b|appeon') THEN 'ui_source' END]) AS kind FROM files) WHERE kind IS NOT NULL
UNION ALL SELECT repo, path, 'clicked', n, trim(text) FROM (SELECT repo, path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM files) WHERE regexp_matches(text, '(?i)Clicked')""")
cte("pkg", f"""SELECT repo, path, lower(array_to_string(list_concat(list_concat(coalesce(json_keys(content, '$.dependencies'), []), coalesce(json_keys(content, '$.devDependencies'), [])), coalesce(json_keys(content, '$.peerDependencies'), [])), ' ')) AS names
FROM files WHERE {LB} = 'package.json' AND json_valid(content)""")
cte("reactish", rf"""SELECT f.repo, f.path, {LB.replace('path', 'f.path')} AS name, coalesce(p.names, '') AS names, f.ext IN ('.js', '.jsx', '.ts', '.tsx') AS js, f.content,
 f.ext IN ('.js', '.jsx', '.ts', '.tsx') AND (regexp_matches(f.content, '\bReact\b|from\s+[''"]react[''"]') OR regexp_matches({base('f.path')}, '\.tsx?\b')) AS react FROM files f LEFT JOIN pkg p ON p.repo = f.repo AND p.path = f.path""")
cte("react_rows", "SELECT repo, count(*) FILTER (WHERE starts_with(name, 'dockerfile') OR list_contains(string_split(path, '/'), 'docker')) AS dockerfiles, count(*) FILTER (WHERE name = 'package.json') AS manifests, count(*) FILTER (WHERE starts_with(name, 'readme')) AS readmes, count(*) FILTER (WHERE react) AS react_files, "
    + ", ".join(f"bool_or((js AND contains(content, '{w}')) OR contains(names, '{w}')) AS {n}" for w, n in [("pdfjs", "uses_pdfjs"), ("react-dropzone", "uses_dropzone"), ("react-router", "uses_router")])
    + ", bool_or((js AND (contains(content, 'tailwind') OR (contains(content, 'className') AND contains(content, 'tw-')))) OR contains(names, 'tailwind')) AS uses_tailwind, bool_or(names <> '') AS has_deps FROM reactish GROUP BY repo")
q("react_docker_signals", "SELECT * EXCLUDE (has_deps), (CASE WHEN dockerfiles > 0 THEN 40 ELSE 0 END + CASE WHEN react_files > 0 THEN 40 ELSE 0 END + CASE WHEN has_deps THEN 20 ELSE 0 END) / 100 AS confidence FROM react_rows")
NAMED_DOC = f"((NOT contains(path, '/') AND regexp_matches({base()}, '^(README|readme)')) OR regexp_matches({base()}, '^(PRIVACY|privacy)'))"
cte("compliance", f"""SELECT repo, bool_or(hit) AS has_gdpr_mention FROM (
 SELECT repo, {rx('content', S.COMPLIANCE)} AS hit FROM files WHERE {NAMED_DOC}
 UNION ALL SELECT repo, {rx('content', S.COMPLIANCE)} AS hit FROM files WHERE ends_with({base()}, '.md')) GROUP BY repo""")
q("compliance_mentions", "SELECT * FROM compliance")
K8S_YAML = f"(ext IN ('.yaml', '.yml') AND {rx('content', S.K8S_KIND)})"
q("k8s_manifests", f"SELECT repo, path FROM files WHERE {K8S_YAML}")

# code
cte("controllers", f"SELECT repo, path AS source_file, regexp_extract(content, {lit(S.CONTROLLER_CLASS)}, 1) AS controller, rtrim(regexp_extract(content, {lit(S.CLASS_MAPPING)}, 1), '/') AS base, string_split(content, chr(10)) AS ls FROM files WHERE ext IN ('.kt', '.java') AND NOT contains(lower(path), '/test/') AND {rx('content', S.CONTROLLER_CLASS)}")
cte("ctl_lines", "SELECT repo, source_file, controller, base, ls, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM controllers")
cte("ctl_hits", f"""SELECT *, 0 AS kind, upper(regexp_extract(text, {lit(S.METHOD_MAPPING)}, 1)) AS method, regexp_extract(text, {lit(S.METHOD_MAPPING)}, 2) AS sub FROM ctl_lines WHERE {rx('text', S.METHOD_MAPPING)}
UNION ALL SELECT *, 1, upper(regexp_extract(text, {lit(S.REQUEST_MAPPING)}, 1)), regexp_extract(text, {lit(S.REQUEST_MAPPING)}, 2) FROM ctl_lines WHERE {rx('text', S.REQUEST_MAPPING)}""")
cte("endpoints", f"""SELECT repo, method, CASE WHEN kind = 0 AND sub = '' THEN CASE WHEN base = '' THEN '/' ELSE base END ELSE replace(base || '/' || sub, '//', '/') END AS path,
 controller || coalesce('.' || list_filter(list_transform(list_slice(ls, line, line + 4), lambda x: regexp_extract(x, {lit(S.FUNCTION_NAME)}, 1)), lambda x: x <> '')[1], '') AS handler, source_file, line, kind FROM ctl_hits""")
q("spring_endpoints", "SELECT repo, method, path, handler, source_file, line FROM endpoints")
cte("services", f"SELECT repo, path AS source_file, unnest(regexp_extract_all(content, {lit(S.PROTO_SERVICE)}, 1)) AS service, unnest(regexp_extract_all(content, {lit(S.PROTO_SERVICE)}, 2)) AS body, unnest(range(len(regexp_extract_all(content, {lit(S.PROTO_SERVICE)}, 1)))) AS svc_no FROM files WHERE ext = '.proto'")
cte("rpcs", "SELECT repo, service, " + ", ".join(f"unnest(regexp_extract_all(body, {lit(S.PROTO_RPC)}, {g})) AS {n}" for g, n in ((1, "rpc"), (2, "request"), (3, "response"))) + f", source_file, svc_no * 1000 + unnest(range(len(regexp_extract_all(body, {lit(S.PROTO_RPC)}, 1)))) AS pos FROM services")
q("proto_rpcs", "SELECT repo, service, rpc, request, response, source_file FROM rpcs")
JVM = f"ext IN ('.kt', '.java') AND NOT contains(lower(path), '/test/') AND NOT contains(lower({stem()}), 'test')"
TABLE = f"nullif(regexp_extract(content, {lit(S.TABLE_NAME)}, 1), '')"
kf, jf = f"regexp_extract_all(content, {lit(S.KOTLIN_FIELD)}, 1)", f"regexp_extract_all(content, {lit(S.JAVA_FIELD)}, 1)"
cte("jpa", f"SELECT repo, unnest(regexp_extract_all(content, {lit(S.JPA_ENTITY)}, 1)) AS name, path AS source_file, {TABLE} AS table_name, array_to_string(list_filter(CASE WHEN len({kf}) > 0 THEN {kf} ELSE {jf} END, lambda f: NOT list_contains({S.FIELD_NOISE}, f)), ',') AS fields, 'jpa_entity' AS entity_type, 0 AS kind, unnest(range(len(regexp_extract_all(content, {lit(S.JPA_ENTITY)}, 1)))) AS pos FROM files WHERE {JVM}")
cte("kdata", f"""SELECT repo, name, path AS source_file, table_name, array_to_string(regexp_extract_all(body, {lit(S.KOTLIN_FIELD)}, 1), ',') AS fields, 'data_class' AS entity_type, 1 AS kind, pos FROM (
 SELECT repo, path, {TABLE} AS table_name, unnest(regexp_extract_all(content, {lit(S.KOTLIN_DATA_CLASS)}, 1)) AS name, unnest(regexp_extract_all(content, {lit(S.KOTLIN_DATA_CLASS)}, 2)) AS body, unnest(range(len(regexp_extract_all(content, {lit(S.KOTLIN_DATA_CLASS)}, 1)))) AS pos FROM files WHERE {JVM}) WHERE len(regexp_extract_all(body, {lit(S.KOTLIN_FIELD)}, 1)) >= 2""")
cte("pmsg", f"""SELECT repo, name, path AS source_file, CAST(NULL AS VARCHAR) AS table_name, array_to_string(regexp_extract_all(body, {lit(S.PROTO_FIELD)}, 1), ',') AS fields, 'proto_message' AS entity_type, 2 AS kind, pos FROM (
 SELECT repo, path, unnest(regexp_extract_all(content, {lit(S.PROTO_MESSAGE)}, 1)) AS name, unnest(regexp_extract_all(content, {lit(S.PROTO_MESSAGE)}, 2)) AS body, unnest(range(len(regexp_extract_all(content, {lit(S.PROTO_MESSAGE)}, 1)))) AS pos FROM files WHERE ext = '.proto')""")
ENT = "repo, name, source_file, table_name, fields, entity_type"
for name, src in [("jpa_entities", "jpa"), ("kotlin_data_classes", "kdata"), ("proto_messages", "pmsg")]:
    q(name, f"SELECT {ENT} FROM {src}")
q("entities", f"SELECT {ENT} FROM (SELECT * FROM jpa UNION ALL SELECT * FROM kdata UNION ALL SELECT * FROM pmsg) QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY kind = 2, source_file, kind, pos) = 1")


# manifests
def clean(e):
    return rf"""regexp_replace({e}, '^[\s"'']+|[\s"'']+$', '', 'g')"""


def depcat(key):
    return case([(anyword(f"lower({key})", f), lit(c)) for c, f in S.DEP_CATEGORY], "'library'")


def un(x, g, col="content"):
    return f"unnest(regexp_extract_all({col}, {lit(x)}, {g}))"


def posn(x, col="content"):
    return f"unnest(range(len(regexp_extract_all({col}, {lit(x)}, 1)))) AS p"


GR = "FROM files WHERE " + inlist(base(), ["build.gradle", "build.gradle.kts"])
cte("gr_plugin", f"SELECT repo, path, {un(S.GRADLE_PLUGIN, 1)} AS short, {un(S.GRADLE_PLUGIN, 2)} AS kv, {un(S.GRADLE_PLUGIN, 3)} AS id, {un(S.GRADLE_PLUGIN, 4)} AS pv, {posn(S.GRADLE_PLUGIN)} {GR}")
cte("gr_ext", f"SELECT repo, path, {un(S.GRADLE_EXT, 1)} AS n, {un(S.GRADLE_EXT, 2)} AS v, {posn(S.GRADLE_EXT)} {GR}")
cte("gr_dep", f"SELECT repo, path, {un(S.GRADLE_DEP, 1)} AS g, {un(S.GRADLE_DEP, 2)} AS a, {un(S.GRADLE_DEP, 3)} AS v, {posn(S.GRADLE_DEP)} {GR}")
cte("gr_jvm", f"SELECT repo, path, {un(S.GRADLE_JVM, 1)} AS v, {posn(S.GRADLE_JVM)} {GR}")
cte("mv_parent", f"SELECT repo, path, {un(S.MAVEN_PARENT, 1)} AS n, {un(S.MAVEN_PARENT, 2)} AS v, {posn(S.MAVEN_PARENT)} FROM files WHERE {base()} = 'pom.xml'")
cte("mv_gav", f"SELECT repo, path, {un(S.MAVEN_GAV, 1)} AS g, {un(S.MAVEN_GAV, 2)} AS a, {un(S.MAVEN_GAV, 3)} AS v, {posn(S.MAVEN_GAV)} FROM files WHERE {base()} = 'pom.xml'")
cte("npm_raw", " UNION ALL ".join(f"SELECT repo, path, {i} AS sec, unnest(json_keys(content, '$.{k}')) AS n, unnest(range(len(json_keys(content, '$.{k}')))) AS p, content, '{k}' AS k FROM files WHERE {base()} = 'package.json' AND json_valid(content)" for i, k in enumerate(("dependencies", "devDependencies"))))
cte("pip_raw", f"SELECT repo, path, t, p FROM (SELECT repo, path, {stripped('unnest(string_split(content, chr(10)))')} AS t, unnest(range(len(string_split(content, chr(10))))) AS p FROM files WHERE {base()} = 'requirements.txt') WHERE t <> '' AND NOT starts_with(t, '#')")
cte("all_deps", f"""
SELECT repo, 'gradle' AS tool, path AS manifest, CASE WHEN short <> '' THEN 'kotlin-' || {clean('short')} ELSE {clean("string_split(id, '.')[-1]")} END AS name, {clean("CASE WHEN short <> '' THEN kv ELSE pv END")} AS version,
  CASE WHEN short <> '' THEN 'language' WHEN contains(lower(id), 'spring') THEN 'framework' ELSE 'build' END AS category, 0 AS rank, 0 AS sec, p FROM gr_plugin
UNION ALL SELECT repo, 'gradle', path, {clean('n')}, {clean('v')}, CASE WHEN contains(lower(n), 'kotlin') THEN 'language' ELSE 'framework' END, 0, 1, p FROM gr_ext
UNION ALL SELECT repo, 'gradle', path, {clean('g')} || ':' || {clean('a')}, {clean('v')}, {depcat(clean('g') + " || ':' || " + clean('a'))}, 0, 2, p FROM gr_dep
UNION ALL SELECT repo, 'gradle', path, 'jvm-target', {clean('v')}, 'language', 0, 3, p FROM gr_jvm
UNION ALL SELECT repo, 'maven', path, n, v, 'framework', 1, 0, p FROM mv_parent
UNION ALL SELECT repo, 'maven', path, g || ':' || a, v, {depcat("g || ':' || a")}, 1, 1, p FROM mv_gav WHERE NOT contains(v, '${{')
UNION ALL SELECT repo, 'npm', path, n, regexp_replace(json_extract_string(content, '$.' || k || '."' || n || '"'), '^[\\^~]+', ''), 'library', 2, sec, p FROM npm_raw
UNION ALL SELECT repo, 'pip', path, trim(regexp_extract(t, '^([^=<>!~]*)', 1)), CASE WHEN regexp_matches(t, '[=<>!~]') THEN trim(regexp_extract(t, '^[^=<>!~]*[=<>!~]+(.*)$', 1)) ELSE 'unspecified' END, 'library', 3, 0, p FROM pip_raw""")
cte("ranked_deps", "SELECT *, row_number() OVER (PARTITION BY repo, manifest ORDER BY sec, p) - 1 AS pos FROM all_deps")
DEPS = "repo, tool, manifest, name, version, category, pos"
q("declared_dependencies", f"SELECT {DEPS} FROM ranked_deps")
for tool in ("gradle", "maven", "npm", "pip"):
    q(f"{tool}_deps", f"SELECT {DEPS} FROM ranked_deps WHERE tool = '{tool}'")
cte("deps", "SELECT repo, name, version, category, manifest, rank, pos FROM ranked_deps QUALIFY row_number() OVER (PARTITION BY repo, lower(name), version ORDER BY rank, manifest, pos) = 1")
q("dependencies", "SELECT repo, name, version, category, manifest FROM deps")
cte("build_rows", f"""SELECT repo, CASE WHEN g THEN 'gradle' WHEN m THEN 'maven' WHEN n THEN 'npm' ELSE 'pip' END AS build_tool,
 CASE WHEN repo IN (SELECT repo FROM gr_ext WHERE contains(lower(n), 'kotlin') UNION SELECT repo FROM gr_plugin WHERE short <> '' OR contains(lower(id), 'kotlin')) THEN 'kotlin' WHEN n THEN 'javascript' WHEN p THEN 'python' ELSE 'unknown' END AS language, j AS uses_jcenter
FROM (SELECT repo, bool_or({inlist(base(), ['build.gradle', 'build.gradle.kts'])}) g, bool_or({base()} = 'pom.xml') m, bool_or({base()} = 'package.json') n, bool_or({base()} = 'requirements.txt') p,
 bool_or({inlist(base(), ['build.gradle', 'build.gradle.kts'])} AND {rx('content', S.JCENTER)}) j FROM files WHERE {inlist(base(), ['build.gradle', 'build.gradle.kts', 'pom.xml', 'package.json', 'requirements.txt'])} GROUP BY repo)""")
q("build_facts", "SELECT * FROM build_rows")
BUCKETS = case([(anyword("lower(name)", f), lit(b)) for b, f in S.DEP_BUCKETS] + [("category = 'framework'", "'framework'")], "'other'")
q("dep_buckets", f"SELECT DISTINCT repo, {BUCKETS} AS bucket, name FROM deps")
cte("meta_rows", r"""SELECT repo, 0 AS rank, path AS source, coalesce(content->>'$.name', '') AS package_name, coalesce(content->>'$.description', '') AS package_description, '' AS keywords FROM files WHERE path = 'package.json' AND json_valid(content)
UNION ALL SELECT repo, 1, path, regexp_extract(content, 'name\s*=\s*"([^"]+)"', 1), regexp_extract(content, 'description\s*=\s*"([^"]+)"', 1), '' FROM files WHERE path = 'pyproject.toml'""")
cte("meta", "SELECT * EXCLUDE (rank) FROM meta_rows QUALIFY row_number() OVER (PARTITION BY repo ORDER BY rank) = 1")
q("package_metadata", "SELECT * FROM meta")


def docstring(c):
    def part(p, g=1):
        return f"CASE WHEN {rx(c, p)} THEN ({stripped(f'regexp_extract({c}, {lit(p)}, 1)')}) END"
    lines = f"list_transform(list_filter(list_slice(string_split({c}, chr(10)), 1, 10), lambda x: regexp_matches(trim(x), '^[/#*]')), lambda x: trim(regexp_replace(x, '^[/ #*]+', '')))"
    return f"""coalesce({part('(?s)^' + chr(92) + 's*' + '"' * 3 + '(.*?)' + '"' * 3)}, {part("(?s)^" + chr(92) + "s*'''(.*?)'''")}, {part('(?s)/' + chr(92) + '*' + chr(92) + '*(.*?)' + chr(92) + '*/')}, array_to_string({lines}, ' '))"""


q("intent_waterfall", f"""SELECT r.repo, coalesce(d.content, '[Extracted from entry point]' || chr(10) || e.doc, '') AS intent, coalesce(d.path, CASE WHEN e.doc IS NOT NULL THEN 'entry_point_docstring' END, 'none') AS source,
 coalesce(package_name, '') AS package_name, coalesce(package_description, '') AS package_description,
 CASE WHEN d.path IS NOT NULL OR e.doc IS NOT NULL THEN 'README present (source: ' || coalesce(d.path, 'entry_point_docstring') || ') — high confidence context.'
  WHEN coalesce(package_description, '') <> '' THEN 'No README found. Context derived from package manifest: ''' || package_description || ''''
  ELSE '[NO_DOCUMENTATION] No README or package description found. Infer from structure only. Assign lower confidence to all features.' END AS confidence_note
FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN (SELECT repo, path, content FROM files WHERE path = 'README.md' AND trim(content) <> '') d USING (repo)
LEFT JOIN (SELECT repo, {docstring('content')} AS doc FROM files WHERE path = 'main.py') e ON e.repo = r.repo AND e.doc <> '' LEFT JOIN meta m ON m.repo = r.repo""")

# evidence
cte("flag_rows", rf"""SELECT repo, bool_or({inlist(base(), S.DOCKER_NAMES)}) AS has_docker, bool_or({hasdir(S.K8S_DIRS, True)} OR {K8S_YAML}) AS has_kubernetes, bool_or({base()} = 'AndroidManifest.xml') AS has_android,
 bool_or(regexp_matches(path, '(\.xcodeproj|\.xcworkspace)(/|$)') OR {base()} = 'Podfile') AS has_ios, bool_or({rx(base(), S.DESKTOP_FILE)}) AS desktop_file, bool_or({hasdir(S.AUTH_DIRS, True)}) AS auth_dir,
 bool_or({hasdir(S.TEST_DIRS, True)} OR {rx(base(), S.TEST_FILE)}) AS has_tests, bool_or({base()} = 'index.html') AS has_index FROM scan GROUP BY repo""")
words = dict(S.DEP_BUCKETS)
cte("dep_flags", f"SELECT repo, bool_or({anyword('lower(name)', words['database'])}) AS db, bool_or({anyword('lower(name)', words['auth'])}) AS au, bool_or({anyword('lower(name)', words['grpc'])}) AS gr, bool_or(contains(lower(name), 'electron')) AS el, count(*) AS n_deps FROM deps GROUP BY repo")
cte("ev0", """SELECT f.*, coalesce(e.n, 0) AS n_endpoints, coalesce(p.n, 0) AS n_rpcs, coalesce(n_deps, 0) AS n_deps, coalesce(e.n, 0) > 0 AS has_http_api, coalesce(p.n, 0) > 0 OR coalesce(gr, false) AS has_grpc, coalesce(db, false) AS has_database,
 coalesce(au, false) OR auth_dir AS has_auth, desktop_file OR coalesce(el, false) AS has_desktop, coalesce(has_gdpr_mention, false) AS has_gdpr_mention, coalesce(build_tool, 'unknown') AS build_tool, coalesce(language, 'unknown') AS primary_language
FROM flag_rows f LEFT JOIN dep_flags d USING (repo) LEFT JOIN compliance c USING (repo) LEFT JOIN (SELECT repo, count(*) n FROM endpoints GROUP BY repo) e USING (repo) LEFT JOIN (SELECT repo, count(*) n FROM rpcs GROUP BY repo) p USING (repo) LEFT JOIN build_rows b USING (repo)""")
FLAGS = "has_http_api has_grpc has_database has_auth has_docker has_kubernetes has_android has_ios has_desktop has_gdpr_mention has_tests".split()
cte("evid", "SELECT repo, " + ", ".join(FLAGS) + ", CASE WHEN has_android THEN 'android' WHEN has_ios THEN 'ios' WHEN has_desktop THEN 'desktop' WHEN has_http_api OR has_grpc THEN 'server' WHEN has_index THEN 'web' ELSE 'library' END AS platform, build_tool, primary_language, n_endpoints, n_rpcs, n_deps FROM ev0")
q("evidence", "SELECT * FROM evid")
q("infra_files", f"""SELECT DISTINCT repo, item FROM (SELECT repo, unnest([CASE WHEN {inlist(base(), S.DOCKER_NAMES)} THEN path END, CASE WHEN dir_no > 0 THEN array_to_string(list_slice(string_split(path, '/'), 1, dir_no), '/') END, CASE WHEN {K8S_YAML} THEN path END]) AS item
FROM (SELECT *, list_position(list_transform(list_slice(string_split(lower(path), '/'), 1, len(string_split(path, '/')) - 1), lambda d: list_contains({S.K8S_DIRS}, d)), true) AS dir_no FROM files)) WHERE item IS NOT NULL""")
cte("evflags", " UNION ALL ".join(f"SELECT repo, '{f}' AS flag, {f} AS value FROM evid" for f in FLAGS))
q("evidence_flags", "SELECT * FROM evflags")
cte("dep_labels", rf"""SELECT repo, label, rank + 4 AS ord FROM (SELECT repo, label, row_number() OVER (PARTITION BY repo ORDER BY rank, manifest, pos) AS rank FROM (
 SELECT *, trim(regexp_replace(string_split(trim(name), ':')[-1], '^[\s"'']+|[\s"'']+$', '', 'g')) AS label FROM deps WHERE NOT {inlist('category', P.STACK_SKIP_CATEGORIES)}) WHERE label <> '' AND NOT {inlist('lower(label)', P.STACK_SKIP_NAMES)}) WHERE rank <= 8""")
cte("labels", f"""SELECT repo, ord::BIGINT AS ord, label FROM (SELECT * FROM dep_labels UNION ALL SELECT repo, {title('primary_language')}, 0 FROM evid WHERE primary_language <> 'unknown' UNION ALL SELECT repo, {title('build_tool')}, 1 FROM evid WHERE build_tool <> 'unknown'
 UNION ALL SELECT repo, {title('platform')}, 2 FROM evid WHERE platform NOT IN ('unknown', 'library') UNION ALL SELECT repo, 'Docker', 3 FROM evid WHERE has_docker UNION ALL SELECT repo, 'Kubernetes', 4 FROM evid WHERE has_kubernetes)
QUALIFY row_number() OVER (PARTITION BY repo, lower(label) ORDER BY ord) = 1""")
q("stack_labels", "SELECT repo, ord, label FROM labels")


def glob(g):
    anywhere = g.startswith("**/")
    body = "".join({"*": ".*", "?": "."}.get(c) or (("\\" + c) if c in r"\.+^$(){}|[]" else c) for c in (g[3:] if anywhere else g).lower())
    return ("^(.*/)?" if anywhere else "^") + body + "$"


q("path_globs", 'SELECT repo, path, "glob" FROM files, (' + values([(g, glob(g)) for g in ["**/*.proto", "**/controllers/**", "docs/*", "**/test_*", "src/**/*.{js,ts}", "**/models/**/*.sql"]]) + ') v("glob", regex) WHERE regexp_matches(lower(path), regex)')
cte("pack_globs", "SELECT DISTINCT repo, pack, g FROM files, (" + values([(p, g, glob(g)) for p, (_, _, _, gs) in P.PACKS.items() for g in gs]) + ") v(pack, g, regex) WHERE regexp_matches(lower(path), regex)")
cte("pack_words", "SELECT DISTINCT repo, pack, w FROM deps, (" + values([(p, w) for p, (_, _, ws, _) in P.PACKS.items() for w in ws]) + ") v(pack, w) WHERE contains(lower(name), lower(w))")
cte("pack_flags", " UNION ALL ".join(f"SELECT repo, '{p}' AS pack, {int(round(t * 1000))} AS threshold, " + (f"(({' + '.join(f'CASE WHEN {f} THEN 1 ELSE 0 END' for f in fl)}) * 1000) // {len(fl)}" if fl else "0") + " AS flag FROM evid" for p, (t, fl, _, _) in P.PACKS.items()))
cte("pack_dims", """SELECT repo, pack, threshold, flag, CASE WHEN w >= 3 THEN 1000 WHEN w = 2 THEN 800 WHEN w = 1 THEN 600 ELSE 0 END AS dep, CASE WHEN g >= 3 THEN 1000 WHEN g = 2 THEN 700 WHEN g = 1 THEN 500 ELSE 0 END AS glb
FROM pack_flags LEFT JOIN (SELECT repo, pack, count(*) w FROM pack_words GROUP BY ALL) USING (repo, pack) LEFT JOIN (SELECT repo, pack, count(*) g FROM pack_globs GROUP BY ALL) USING (repo, pack)""")
cte("pack_points", "SELECT repo, pack, threshold, CASE WHEN (flag > 0)::INT + (dep > 0)::INT + (glb > 0)::INT >= 2 THEN least(1000, greatest(flag, dep, glb) + 150) ELSE greatest(flag, dep, glb) END AS points FROM pack_dims")
q("pack_score", "SELECT repo, pack, points / 1000 AS score FROM pack_points")
cte("active", "SELECT repo, pack, points / 1000 AS score FROM pack_points WHERE points >= threshold")
q("active_packs", "SELECT * FROM active")
q("evidence_fingerprint", "SELECT repo, md5(concat_ws(';', " + ", ".join(f"'{c}=' || {c}::VARCHAR" for c in "platform primary_language has_http_api has_grpc has_android has_ios has_database build_tool".split()) + ", 'framework='))[1:8] AS fingerprint FROM evid")
