"""The queries in SQL, for comparison."""

from __future__ import annotations

from graphloom.functions.ids import NAMESPACE

_NS = NAMESPACE.hex

E_ = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY coalesce(indexed_at, TIMESTAMP '0001-01-01') DESC, coalesce(signature, '') DESC, coalesce(docstring, '') DESC, coalesce(fqn, '') DESC, coalesce(start_line, -1) DESC) AS rn
  FROM entities WHERE uuid IS NOT NULL) WHERE rn = 1)"""
G_ = "g AS (SELECT DISTINCT lower(trim(src_uuid)) AS src_uuid, lower(trim(dst_uuid)) AS dst_uuid, rel_type FROM edges WHERE src_uuid IS NOT NULL AND dst_uuid IS NOT NULL AND rel_type IS NOT NULL)"
F_ = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC, coalesce(language, '') DESC) AS rn FROM files) WHERE rn = 1)"
I_ = "i AS (SELECT * REPLACE (trim(target) AS target) FROM (SELECT *, row_number() OVER (PARTITION BY intent_id) AS rn FROM intents) WHERE rn = 1)"
V_ = "v AS (SELECT DISTINCT uuid, repo_name, len(embedding)::INT AS dims FROM vectors WHERE embedding IS NOT NULL)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


REFS = "SELECT g.rel_type, t.fqn AS target, t.file_path AS target_file, t.start_line AS target_line, s.uuid AS src_uuid, s.name, s.kind, s.file_path, s.start_line, s.repo_name FROM g JOIN e t ON t.uuid = g.dst_uuid JOIN e s ON s.uuid = g.src_uuid WHERE "
FOUR = "g.rel_type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS', 'REFERENCES') AND "


def _match(n: str) -> str:
    return f"(t.name = '{n}' OR t.fqn = '{n}' OR contains(t.name || coalesce(t.signature, ''), '{n}'))"


STATE = (
    F_,
    "cur AS (SELECT repo_name, path, max(sha256) AS new, 1 AS here FROM f GROUP BY 1, 2)",
    "old AS (SELECT repo_name, path, max(sha256) AS old, 1 AS there FROM (SELECT repo_name, path, sha256 FROM f WHERE scanned_at < TIMESTAMP '2025-07-01' AND NOT EXISTS (SELECT 1 FROM removals r WHERE r.repo_name = f.repo_name AND r.file_path = f.path) UNION ALL SELECT repo_name, file_path, NULL FROM removals) GROUP BY 1, 2)",
    "c AS (SELECT coalesce(cur.repo_name, old.repo_name) AS repo_name, coalesce(cur.path, old.path) AS path, CASE WHEN here IS NULL THEN 'deleted' WHEN there IS NULL THEN 'added' WHEN new = old.old THEN 'unchanged' ELSE 'modified' END AS status FROM cur FULL JOIN old ON cur.repo_name = old.repo_name AND cur.path = old.path)",
)
DEAD = "dead AS (SELECT DISTINCT e.uuid FROM e JOIN removals r ON r.repo_name = e.repo_name AND r.file_path = e.file_path)"
SPAN = "sp AS (SELECT repo_name, file_path, uuid, start_line, end_line FROM e WHERE start_line IS NOT NULL), r AS (SELECT repo_name, src_file AS file_path, intent_id AS ref_id, line FROM i WHERE line IS NOT NULL)"
QV = "q AS (SELECT embedding::DOUBLE[] AS x FROM embeddings ORDER BY vec_id LIMIT 1)"
PICK = "arg_min(uuid, {'f': coalesce(file_path, ''), 'l': coalesce(start_line, 0), 'u': uuid})"
NAMES = f"nm AS (SELECT name AS key, {PICK} AS uuid FROM e WHERE name IS NOT NULL GROUP BY 1), fm AS (SELECT coalesce(fqn, name) AS key, {PICK} AS uuid FROM e WHERE coalesce(fqn, name) IS NOT NULL GROUP BY 1)"
REL = """CASE intent_type WHEN 'Extends' THEN 'EXTENDS' WHEN 'Implements' THEN 'IMPLEMENTS' WHEN 'TypeReference' THEN 'REFERENCES' WHEN 'ValueReference' THEN 'REFERENCES' WHEN 'DomElementReference' THEN 'REFERENCES_DOM'
  WHEN 'CssClassUsage' THEN 'USES_CSS_CLASS' WHEN 'HtmlFileImport' THEN 'IMPORTS_SCRIPT' WHEN 'CssFileImport' THEN 'IMPORTS_STYLESHEET' WHEN 'RustMacroCall' THEN 'MACRO_CALLS' END"""
CAP = "upper(substr(rc, 1, 1)) || substr(rc, 2)"
CALLS = (
    E_, I_, NAMES,
    "par AS (SELECT e.name AS cls, i.target AS parent, min(i.seq) AS n FROM i JOIN e ON e.uuid = i.src_uuid WHERE i.intent_type = 'Extends' AND i.target IS NOT NULL GROUP BY 1, 2)",
    "k AS (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT src_uuid, src_file, repo_name AS of, src_enclosing_class AS cls, target AS method, receiver, trim(split_part(receiver, '.', -1)) AS rc FROM i WHERE intent_type = 'Call' AND target IS NOT NULL AND src_uuid IS NOT NULL))",
    f"""t AS (SELECT id, 1 AS p, cls || '.' || method AS fqn, 1 AS step FROM k WHERE (receiver IS NULL OR receiver IN ('this', 'self')) AND cls IS NOT NULL
      UNION ALL SELECT id, 99 + row_number() OVER (PARTITION BY id ORDER BY n, parent), parent || '.' || method, 2 FROM k JOIN par ON par.cls = k.cls WHERE receiver = 'self'
      UNION ALL SELECT id, 1000000, receiver || '.' || method, 3 FROM k WHERE regexp_matches(receiver, '^\\p{{Lu}}')
      UNION ALL SELECT id, 1000001, rc || '.' || method, 4 FROM k WHERE receiver IS NOT NULL
      UNION ALL SELECT id, 1000002, {CAP} || '.' || method, 5 FROM k WHERE receiver IS NOT NULL)""",
    "direct AS (SELECT t.id, arg_min(fm.uuid, p) AS uuid, arg_min(step, p) AS step FROM t JOIN fm ON fm.key = t.fqn GROUP BY 1)",
    f"""pr AS (SELECT DISTINCT rc, method FROM k WHERE rc <> '' AND method <> '' AND id NOT IN (SELECT id FROM direct)),
      fz AS (SELECT rc, method, arg_min(uuid, {{'k': key, 'u': uuid}}) AS uuid FROM pr JOIN fm ON contains(key, rc || '.' || method) OR contains(key, {CAP} || '.' || method) GROUP BY 1, 2),
      fuzzy AS (SELECT k.id, fz.uuid, 6 AS step FROM k JOIN fz USING (rc, method) WHERE receiver IS NOT NULL AND id NOT IN (SELECT id FROM direct))""",
    """same AS (SELECT name AS method, file_path AS src_file, repo_name AS of, arg_min(uuid, {'l': coalesce(start_line, 0), 'u': uuid}) AS uuid FROM e WHERE name IS NOT NULL GROUP BY 1, 2, 3),
      last AS (SELECT k.id, coalesce(same.uuid, nm.uuid) AS uuid, CASE WHEN same.uuid IS NULL THEN 8 ELSE 7 END AS step FROM k JOIN nm ON nm.key = k.method LEFT JOIN same ON same.method = k.method AND same.src_file = k.src_file AND same.of = k.of
        WHERE id NOT IN (SELECT id FROM direct) AND id NOT IN (SELECT id FROM fuzzy)),
      res AS (SELECT k.*, x.uuid, x.step FROM k JOIN (SELECT * FROM direct UNION ALL SELECT * FROM fuzzy UNION ALL SELECT * FROM last) x USING (id))""",
)
SECTION = """CASE kind WHEN 'class' THEN 'Classes' WHEN 'kotlin_class' THEN 'Classes' WHEN 'interface' THEN 'Interfaces' WHEN 'kotlin_interface' THEN 'Interfaces' WHEN 'kotlin_object' THEN 'Objects' WHEN 'kotlin_companion_object' THEN 'Companion objects'
  WHEN 'method' THEN 'Methods' WHEN 'kotlin_method' THEN 'Methods' WHEN 'function' THEN 'Functions' WHEN 'kotlin_function' THEN 'Functions' WHEN 'kotlin_property' THEN 'Properties' WHEN 'python_class' THEN 'Python classes' WHEN 'python_constant' THEN 'Python constants'
  WHEN 'python_function' THEN 'Python functions' WHEN 'python_method' THEN 'Python methods' WHEN 'python_module' THEN 'Python modules' WHEN 'rust_struct' THEN 'Rust structs' WHEN 'rust_enum' THEN 'Rust enums' WHEN 'rust_union' THEN 'Rust unions' WHEN 'rust_trait' THEN 'Rust traits'
  WHEN 'rust_impl' THEN 'Rust impls' WHEN 'rust_function' THEN 'Rust functions' WHEN 'rust_method' THEN 'Rust methods' WHEN 'rust_macro_def' THEN 'Rust macros' WHEN 'rust_macro_invoke' THEN 'Rust macros' WHEN 'rust_type_alias' THEN 'Rust type aliases'
  WHEN 'rust_constant' THEN 'Rust constants' WHEN 'rust_static' THEN 'Rust statics' WHEN 'rust_module' THEN 'Rust modules' WHEN 'constant' THEN 'Constants' WHEN 'enum' THEN 'Enums' WHEN 'html_element' THEN 'Elements' WHEN 'html_id' THEN 'Ids' WHEN 'css_id' THEN 'Ids'
  WHEN 'html_class' THEN 'CSS classes' WHEN 'css_class' THEN 'CSS classes' WHEN 'css_variable' THEN 'Variables' WHEN 'scss_variable' THEN 'Variables' WHEN 'scss_mixin' THEN 'Mixins' WHEN 'scss_function' THEN 'SCSS functions' END"""
COSINE = "SELECT vec_id AS uuid, score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], x), 6) AS score FROM embeddings, q {w} ORDER BY score DESC, vec_id LIMIT 5)"
INDEX = (
    "v AS (SELECT uuid, repo_name, embedding::DOUBLE[] AS embedding FROM vectors WHERE uuid IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 384 AND len(list_filter(embedding, lambda y: y <> 0)) > 0)",
    "q AS (SELECT embedding AS x FROM v ORDER BY uuid, embedding LIMIT 1)",
)
TOP = "SELECT uuid, score, row_number() OVER (ORDER BY score DESC, uuid)::INT AS rank FROM (SELECT uuid, max(round(list_cosine_similarity(embedding, x), 6)) AS score FROM v, q {w} GROUP BY uuid ORDER BY score DESC, uuid LIMIT 5)"
PARENT = """
WITH parent AS (
  SELECT repo_name, file_path AS path, lower(trim(uuid)) AS uuid, fqn, false AS is_file, indexed_at AS s FROM entities WHERE indexed_at IS NOT NULL
  UNION ALL SELECT repo_name, path, NULL, NULL, true, scanned_at FROM files WHERE scanned_at IS NOT NULL),
live AS (
  SELECT p.*, (SELECT min(r.removed_at) FROM removals r WHERE r.repo_name = p.repo_name AND r.file_path = p.path AND r.removed_at >= p.s) AS e FROM parent p),
k AS (
  SELECT 'p' AS space, repo_name AS scope, path AS key, s, e FROM live WHERE is_file
  UNION ALL SELECT 'u', '', uuid, s, e FROM live WHERE NOT is_file
  UNION ALL SELECT 'f', repo_name, fqn, s, e FROM live WHERE NOT is_file),
ref AS (
  SELECT 'intents' AS ref_table, intent_id AS ref_id, repo_name AS scope, recorded_at AS tm,
    CASE WHEN intent_type IN ('HtmlFileImport', 'CssFileImport') THEN 'p' ELSE 'f' END AS space,
    CASE WHEN intent_type IN ('HtmlFileImport', 'CssFileImport') THEN trim(target)
      WHEN intent_type = 'DomElementReference' THEN '#' || trim(target)
      WHEN intent_type = 'CssClassUsage' THEN '.' || trim(target)
      WHEN intent_type = 'RustMacroCall' THEN trim(target) || '!'
      ELSE coalesce(CASE WHEN receiver IN ('this', 'self') THEN src_enclosing_class ELSE receiver END
        || CASE WHEN src_file LIKE '%.rs' THEN '::' ELSE '.' END, '') || trim(target) END AS key
  FROM intents
  UNION ALL SELECT 'edges', edge_id, '', resolved_at, 'u', lower(trim(src_uuid)) FROM edges
  UNION ALL SELECT 'edges', edge_id, '', resolved_at, 'u', lower(trim(dst_uuid)) FROM edges),
orphan AS (
  SELECT ref_table, ref_id, min(tm) AS tm FROM ref
  WHERE key IS NOT NULL AND tm IS NOT NULL AND NOT (space = 'f' AND EXISTS (SELECT 1 FROM external_names x WHERE x.name = key))
    AND NOT EXISTS (SELECT 1 FROM k WHERE k.space = ref.space AND k.scope = ref.scope AND k.key = ref.key AND ref.tm >= k.s AND (k.e IS NULL OR ref.tm < k.e))
  GROUP BY 1, 2)
"""
STRIP = "regexp_replace(x, '(^[ \\t\\r]+|[ \\t\\r]+$)', '', 'g')"
for _m in (r"^/\*\*", r"^/\*", r"\*/$", "^///", "^//", r"^[ \t]*\*", "^#"):
    STRIP = f"regexp_replace({STRIP}, '{_m}', '')"

SQL: dict[str, str] = {
    "p2_found": PARENT + "SELECT ref_table, ref_id FROM orphan",
    "p2_report": PARENT + "SELECT ref_table, strftime(tm, '%Y-%m') AS month, count(*) AS orphans FROM orphan GROUP BY 1, 2",
    "current_entities": _with(E_) + "SELECT uuid, name, kind, fqn, signature, docstring, file_path, start_line, repo_name FROM e",
    "find_references": _with(E_, G_) + REFS + FOUR + _match("(tree"),
    "find_references_repo": _with(E_, G_) + REFS + FOUR + _match("Index") + " AND t.repo_name = 'harbor-core'",
    "find_callers_strict": _with(E_, G_) + REFS + "g.rel_type = 'CALLS' AND (t.name = 'trimDigest' OR t.fqn = 'trimDigest')",
    "find_references_all_relations": _with(E_, G_) + REFS + "g.rel_type IN ('REFERENCES_DOM', 'USES_CSS_CLASS', 'MACRO_CALLS', 'IMPORTS_SCRIPT', 'IMPORTS_STYLESHEET') AND " + _match("-"),
    "callers_grouped_by_target": _with(E_, G_) + "SELECT rel_type, CASE WHEN target_file IS NULL THEN 'unknown' WHEN target_line IS NULL THEN target_file ELSE target_file || ':' || target_line END AS target_key, count(*) AS n_references FROM (" + REFS + FOUR + _match("(") + ") GROUP BY 1, 2",
    "reference_counts": _with(E_, G_) + "SELECT rel_type, count(*) AS n_edges FROM g WHERE src_uuid IN (SELECT uuid FROM e) AND dst_uuid IN (SELECT uuid FROM e) GROUP BY 1",
    "dead_entities": _with(E_, G_) + "SELECT uuid, name, kind FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.dst_uuid = e.uuid)",
    "dependencies": _with(E_, G_) + "SELECT e.uuid, e.name, e.fqn, coalesce(string_agg(c.name, ',' ORDER BY c.name), '') AS calls, count(c.name) AS n_calls FROM e LEFT JOIN (SELECT g.src_uuid, t.name FROM g JOIN e t ON t.uuid = g.dst_uuid WHERE rel_type = 'CALLS') c ON c.src_uuid = e.uuid GROUP BY ALL",
    "enrich_entities": _with(E_, G_, "x AS (SELECT g.dst_uuid AS uuid, g.rel_type, e.name, coalesce(e.name, '?') || ' in ' || coalesce(e.file_path, '?') AS sample, row_number() OVER (PARTITION BY g.dst_uuid, g.rel_type ORDER BY coalesce(e.name, '?') || ' in ' || coalesce(e.file_path, '?'), e.uuid) AS r FROM g JOIN e ON e.uuid = g.src_uuid WHERE rel_type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS', 'REFERENCES'))")
    + """SELECT uuid, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (rel_type = 'EXTENDS'), '') AS subclasses, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (rel_type = 'IMPLEMENTS'), '') AS implementers,
    count(*) FILTER (rel_type = 'REFERENCES') AS type_usage_count, coalesce(string_agg(sample, '; ' ORDER BY sample) FILTER (rel_type = 'REFERENCES' AND r <= 3), '') AS type_usage_samples,
    count(*) FILTER (rel_type = 'CALLS') AS caller_count, coalesce(string_agg(sample, '; ' ORDER BY sample) FILTER (rel_type = 'CALLS' AND r <= 3), '') AS caller_samples FROM x GROUP BY 1""",
    "explore_files": _with(E_) + f"SELECT repo_name, file_path, section, count(*) AS n, min(start_line) AS first_line, max(start_line) AS last_line FROM (SELECT *, {SECTION} AS section FROM e) WHERE section IS NOT NULL GROUP BY 1, 2, 3",
    "contains_edges": _with(E_) + "SELECT o.src_uuid, e.uuid AS dst_uuid, 'CONTAINS' AS rel_type FROM e JOIN (SELECT repo_name, file_path, name, min(uuid) AS src_uuid FROM e WHERE kind IN ('class', 'interface', 'enum', 'kotlin_class', 'kotlin_interface', 'kotlin_object', 'python_class', 'rust_struct', 'rust_enum', 'rust_trait') GROUP BY 1, 2, 3) o ON o.repo_name = e.repo_name AND o.file_path = e.file_path AND o.name = e.enclosing_class",
    "impact": "WITH RECURSIVE " + ", ".join((E_, G_, "w AS (SELECT uuid, 0 AS depth FROM e WHERE contains(lower(name), 'index') UNION SELECT g.src_uuid, w.depth + 1 FROM w JOIN g ON g.dst_uuid = w.uuid WHERE w.depth < 3)")) + " SELECT uuid, min(depth) AS depth FROM w GROUP BY 1",
    "vector_topk_embeddings": _with(QV) + COSINE.format(w=""),
    "vector_topk": _with(*INDEX) + TOP.format(w=""),
    "vector_topk_filtered": _with(*INDEX) + TOP.format(w="WHERE repo_name = 'harbor-core'"),
    "hybrid_search": _with(E_, G_, *INDEX, f"h AS ({TOP.format(w='')})", "x AS (SELECT g.dst_uuid AS uuid, g.rel_type, e.name, coalesce(e.name, '?') || ' in ' || coalesce(e.file_path, '?') AS sample, row_number() OVER (PARTITION BY g.dst_uuid, g.rel_type ORDER BY coalesce(e.name, '?') || ' in ' || coalesce(e.file_path, '?'), e.uuid) AS r FROM g JOIN e ON e.uuid = g.src_uuid)")
    + """SELECT h.rank, h.score, h.uuid, e.name, e.kind, e.fqn, e.signature, e.docstring, e.file_path, e.start_line, e.repo_name, coalesce((SELECT string_agg(t.name, ',' ORDER BY t.name) FROM g JOIN e t ON t.uuid = g.dst_uuid WHERE g.src_uuid = h.uuid AND g.rel_type = 'CALLS'), '') AS calls,
    coalesce((SELECT string_agg(DISTINCT x.name, ',' ORDER BY x.name) FROM x WHERE x.uuid = h.uuid AND x.rel_type = 'EXTENDS'), '') AS subclasses, coalesce((SELECT string_agg(DISTINCT x.name, ',' ORDER BY x.name) FROM x WHERE x.uuid = h.uuid AND x.rel_type = 'IMPLEMENTS'), '') AS implementers,
    (SELECT count(*) FROM x WHERE x.uuid = h.uuid AND x.rel_type = 'CALLS') AS caller_count, coalesce((SELECT string_agg(x.sample, '; ' ORDER BY x.sample) FROM x WHERE x.uuid = h.uuid AND x.rel_type = 'CALLS' AND x.r <= 3), '') AS caller_samples,
    (SELECT count(*) FROM x WHERE x.uuid = h.uuid AND x.rel_type = 'REFERENCES') AS type_usage_count, coalesce((SELECT string_agg(x.sample, '; ' ORDER BY x.sample) FROM x WHERE x.uuid = h.uuid AND x.rel_type = 'REFERENCES' AND x.r <= 3), '') AS type_usage_samples FROM h JOIN e ON e.uuid = h.uuid""",
    "entity_uuid5": f"SELECT DISTINCT uuid, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS computed FROM (SELECT uuid, sha1(unhex('{_NS}') || encode(concat_ws(':', repo_name, file_path, fqn))) AS h FROM entities)",
    "point_ids": _with(E_) + "SELECT uuid, (CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END)::BIGINT AS point_id FROM (SELECT uuid, xor(('0x' || substr(replace(uuid, '-', ''), 1, 16))::UBIGINT, ('0x' || substr(replace(uuid, '-', ''), 17, 16))::UBIGINT)::HUGEINT AS p FROM e)",
    "embed_text": _with(E_) + """SELECT uuid, concat_ws(chr(10), '[' || kind || '] ' || name, CASE WHEN len(list_filter(decorators, lambda s: trim(s) <> '')) > 0 THEN 'Decorators: ' || array_to_string(list_filter(decorators, lambda s: trim(s) <> ''), ', ') END, 'Signature: ' || signature,
    CASE WHEN trim(docstring) <> '' THEN trim(docstring) END, CASE WHEN len(list_filter(inline_comments, lambda s: trim(s) <> '')) > 0 THEN 'Implementation context:' || chr(10) || array_to_string(list_transform(list_filter(inline_comments, lambda s: trim(s) <> ''), lambda s: trim(s)), chr(10)) END, 'File: ' || file_path || ':' || start_line) AS embed_text FROM e""",
    "strip_comments": f"SELECT DISTINCT docstring AS raw, coalesce(array_to_string(list_filter(list_transform(string_split(docstring, chr(10)), lambda x: trim(replace(replace({STRIP}, chr(9), ' '), chr(13), ' '))), lambda s: s <> ''), chr(10)), '') AS stripped FROM entities WHERE docstring IS NOT NULL",
    "content_hash": _with(F_) + "SELECT file_id, sha256(content) AS computed, sha256 FROM f WHERE content IS NOT NULL",
    "supported_files": _with(F_) + """SELECT file_id, x IN ('java', 'kt', 'kts', 'ts', 'tsx', 'cts', 'js', 'mjs', 'cjs', 'jsx', 'html', 'htm', 'css', 'scss', 'sass', 'py', 'pyi', 'pyw', 'rs') AS supported,
    CASE WHEN x = 'java' THEN 'java' WHEN x IN ('kt', 'kts') THEN 'kotlin' WHEN x IN ('ts', 'tsx', 'cts') THEN 'typescript' WHEN x IN ('js', 'mjs', 'cjs', 'jsx') THEN 'javascript' WHEN x IN ('html', 'htm') THEN 'html' WHEN x = 'css' THEN 'css' WHEN x IN ('scss', 'sass') THEN 'scss' WHEN x IN ('py', 'pyi', 'pyw') THEN 'python' WHEN x = 'rs' THEN 'rust' END AS lang_of_path
    FROM (SELECT file_id, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS x FROM f)""",
    "file_classify": _with(*STATE) + "SELECT status, count(*) AS n FROM c GROUP BY 1",
    "files_to_delete": _with(*STATE) + "SELECT repo_name, path FROM c WHERE status IN ('deleted', 'modified', 'added')",
    "files_to_parse": _with(*STATE) + "SELECT repo_name, path FROM c WHERE status IN ('added', 'modified')",
    "affected_intents": _with(*STATE, I_, E_) + "SELECT intent_id FROM i WHERE EXISTS (SELECT 1 FROM c WHERE c.repo_name = i.repo_name AND c.path = i.src_file AND status IN ('added', 'modified')) OR regexp_extract(target, '([^.:#!]+)!?$', 1) IN (SELECT name FROM e WHERE contains(lower(name), 'index'))",
    "delete_by_files": _with(E_, DEAD) + "SELECT uuid FROM e WHERE uuid NOT IN (SELECT uuid FROM dead)",
    "delete_by_files_edges": _with(E_, G_, DEAD) + "SELECT * FROM g WHERE src_uuid NOT IN (SELECT uuid FROM dead) AND dst_uuid NOT IN (SELECT uuid FROM dead)",
    "delete_by_files_vectors": _with(E_, V_, DEAD) + "SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.uuid = v.uuid)",
    "delete_repo": _with(E_, G_) + "SELECT * FROM g WHERE src_uuid NOT IN (SELECT uuid FROM e WHERE repo_name = 'harbor-core') AND dst_uuid NOT IN (SELECT uuid FROM e WHERE repo_name = 'harbor-core')",
    "delete_repo_entities": _with(E_) + "SELECT uuid FROM e WHERE repo_name IS DISTINCT FROM 'harbor-core'",
    "delete_repo_vectors": _with(E_, V_) + "SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.uuid = v.uuid AND e.repo_name = 'harbor-core')",
    "upsert_entities": _with(E_) + "SELECT uuid, CASE WHEN kind = 'class' THEN name || 'V2' ELSE name END AS name, kind FROM e",
    "upsert_edges": _with(E_, G_) + "SELECT * FROM g WHERE rel_type <> 'CALLS' OR (src_uuid IN (SELECT uuid FROM e) AND dst_uuid IN (SELECT uuid FROM e))",
    "upsert_calls": _with(E_, G_) + "SELECT * FROM g WHERE rel_type = 'EXTENDS' OR (rel_type = 'CALLS' AND src_uuid IN (SELECT uuid FROM e) AND dst_uuid IN (SELECT uuid FROM e))",
    "entity_dedup": "SELECT uuid, name, kind, signature, repo_name, file_path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path, name, kind, start_line ORDER BY signature IS NULL, signature, uuid) AS rn FROM (SELECT DISTINCT uuid, name, kind, signature, repo_name, file_path, start_line FROM entities)) WHERE rn = 1",
    "resolve_by_name": _with(E_, I_, NAMES) + f"SELECT DISTINCT i.src_uuid, nm.uuid AS dst_uuid, {REL} AS rel_type FROM i JOIN nm ON nm.key = i.target WHERE intent_type NOT IN ('Call', 'HtmlFileImport', 'CssFileImport') AND src_uuid IS NOT NULL",
    "resolve_imports": _with(E_, I_) + f"SELECT DISTINCT i.src_uuid, x.uuid AS dst_uuid, {REL} AS rel_type FROM i JOIN (SELECT repo_name, file_path, arg_min(uuid, {{'l': coalesce(start_line, 0), 'u': uuid}}) AS uuid FROM e GROUP BY 1, 2) x ON x.file_path = i.target AND x.repo_name = i.repo_name WHERE intent_type IN ('HtmlFileImport', 'CssFileImport') AND src_uuid IS NOT NULL",
    "resolve_calls": _with(*CALLS) + "SELECT src_uuid, method, receiver, uuid, step FROM res WHERE step <> 6",
    "resolve_inherited": _with(*CALLS) + "SELECT cls, parent, n FROM par",
    "fuzzy_fqn": _with(E_, "fm AS (SELECT coalesce(fqn, name) AS key, arg_min(uuid, {'f': coalesce(file_path, ''), 'l': coalesce(start_line, 0), 'u': uuid}) AS uuid FROM e WHERE coalesce(fqn, name) IS NOT NULL GROUP BY 1)",
      "k AS (SELECT uuid AS src_uuid, substr(string_split(fqn, '.')[-1], 1, 5) AS method, substr(string_split(fqn, '.')[-2], 3) AS rc FROM e WHERE contains(fqn, '.'))",
      "kk AS (SELECT * FROM k WHERE rc <> '' AND method <> '' AND rc || '.' || method NOT IN (SELECT key FROM fm) AND upper(substr(rc, 1, 1)) || substr(rc, 2) || '.' || method NOT IN (SELECT key FROM fm))",
      "pr AS (SELECT DISTINCT rc, method FROM kk)", "fz AS (SELECT rc, method, arg_min(uuid, {'k': key, 'u': uuid}) AS uuid FROM pr JOIN fm ON contains(key, rc || '.' || method) OR contains(key, upper(substr(rc, 1, 1)) || substr(rc, 2) || '.' || method) GROUP BY 1, 2)")
      + "SELECT kk.src_uuid, kk.method, kk.rc AS receiver, fz.uuid FROM kk JOIN fz USING (rc, method)",
    "resolve_by_repo": _with(E_, I_, "cx AS (SELECT DISTINCT repo_name, repo_name AS of FROM e UNION SELECT DISTINCT repo_name, 'harbor-core' FROM e)",
      "nm AS (SELECT cx.repo_name, e.name AS key, arg_min(e.uuid, {'o': cx.of <> cx.repo_name, 'f': coalesce(file_path, ''), 'l': coalesce(start_line, 0), 'u': e.uuid}) AS uuid FROM cx JOIN e ON e.repo_name = cx.of WHERE e.name IS NOT NULL GROUP BY 1, 2)")
      + f"SELECT DISTINCT i.src_uuid, nm.uuid AS dst_uuid, {REL} AS rel_type FROM i JOIN nm ON nm.key = i.target AND nm.repo_name = i.repo_name WHERE intent_type NOT IN ('Call', 'HtmlFileImport', 'CssFileImport') AND src_uuid IS NOT NULL",
    "name_map": _with(E_, NAMES) + "SELECT key, uuid FROM nm",
    "cross_repo_context": _with(E_) + "SELECT coalesce(fqn, name) AS key, arg_min(uuid, {'o': repo_name <> 'harbor-core', 'f': coalesce(file_path, ''), 'l': coalesce(start_line, 0), 'u': uuid}) AS uuid FROM e WHERE repo_name IN ('harbor-core', 'ember-vault-ba0', 'vale-loom-ba1') GROUP BY 1",
    "nearest_entity": _with(E_, I_, SPAN) + """SELECT ref_id, arg_min(uuid, {'t': CASE WHEN start_line <= line AND line <= coalesce(end_line, 1073741824) THEN 0 WHEN start_line <= line THEN 1 ELSE 2 END,
    'd': CASE WHEN start_line <= line AND line <= coalesce(end_line, 1073741824) THEN coalesce(end_line, 1073741824) - start_line ELSE abs(line - start_line) END, 's': start_line, 'u': uuid}) AS uuid FROM r JOIN sp USING (repo_name, file_path) GROUP BY 1""",
    "nearest_entity_before": _with(E_, I_, SPAN) + "SELECT ref_id, arg_min(uuid, {'t': CASE WHEN start_line <= line THEN 0 ELSE 1 END, 'd': CASE WHEN start_line <= line THEN -start_line ELSE start_line END, 'u': uuid}) AS uuid FROM r JOIN sp USING (repo_name, file_path) GROUP BY 1",
    "enclosing_context": _with(E_, I_, SPAN, "cl AS (SELECT repo_name, file_path, name, start_line, end_line FROM e WHERE kind IN ('class', 'interface', 'python_class', 'kotlin_class') AND end_line IS NOT NULL)")
    + "SELECT r.ref_id AS row_id, arg_min(cl.name, {'l': cl.start_line, 'n': cl.name}) AS enclosing FROM r LEFT JOIN cl ON cl.repo_name = r.repo_name AND cl.file_path = r.file_path AND cl.start_line < r.line AND r.line < cl.end_line GROUP BY 1",
    "orphan_lines": _with(E_, I_, SPAN) + "SELECT x.uuid AS ref_id FROM e x WHERE x.end_line IS NOT NULL AND x.repo_name IS NOT NULL AND x.file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.repo_name = x.repo_name AND sp.file_path = x.file_path AND sp.end_line IS NOT NULL AND x.end_line + 1 BETWEEN sp.start_line AND sp.end_line)",
    "watch_batches": """SELECT path, batch, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT user_id AS path, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS batch FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY 1, 2""",
    "watch_dedup": "SELECT DISTINCT user_id, event_type FROM events WHERE user_id IS NOT NULL",
}
# extraction: every declaration that the index holds of a file whose text still has its name, with its name, kind and full name
SQL |= {
    f"extract_{language}": _with(E_, F_) + f"""SELECT e.uuid, e.name, e.kind, e.fqn, e.repo_name, e.file_path FROM e JOIN f ON f.repo_name = e.repo_name AND f.path = e.file_path
    WHERE regexp_matches(f.path, '\\.({ext})$') AND length(regexp_replace(f.content, '[^"]', '', 'g')) % 2 = 0 AND contains(f.content, e.name)"""
    for language, ext in {"java": "java", "kotlin": "kts?", "typescript": "ts|tsx|cts", "javascript": "js|mjs|cjs|jsx", "html": "html?", "css": "css", "scss": "scss|sass", "python": "py|pyi|pyw", "rust": "rs"}.items()
}
