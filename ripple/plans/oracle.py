"""DuckDB SQL twins of the registered queries, written against the same tables."""

import re

from ripple.sources.warehouse import BASE_END, HEAD_START, PART_SPAN

ORD = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
RANK = "CASE {} WHEN 'exact' THEN 0 WHEN 'single_impl' THEN 1 WHEN 'regex' THEN 2 WHEN 'ambiguous' THEN 3 END"
NAMES = "(['exact','single_impl','regex','ambiguous'])[{} + 1]"


def pk(p):
    return (f"'fn:com.acme.part.P'||{p}||'#'||(['find','get','save','delete','count','run'])[CAST({p} % 6 AS INT) + 1]"
            "||'(java.lang.Long)'")


def pf(p):
    return f"'src/main/java/com/acme/P'||{p}||'.java'"


LINES = f"""
li AS (SELECT *, w = lead_w AS is_lead, lead_w % {PART_SPAN} AS lead_part FROM (
  SELECT *, max(w) OVER (PARTITION BY l_orderkey) AS lead_w FROM (
  SELECT 'r'||c_nationkey AS repo_id, l.*, o_orderdate, o_orderpriority,
    o_orderdate < TIMESTAMP '{BASE_END}' AS in_base, o_orderdate >= TIMESTAMP '{HEAD_START}' AS in_head,
    ((l_partkey * 7919 + l_orderkey * 104729) % 1000003) * {PART_SPAN} + l_partkey AS w
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)))"""

NODE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'route:GET /o/'||l_orderkey WHEN '2-HIGH' THEN 'route:POST /o/'||l_orderkey
  WHEN '3-MEDIUM' THEN 'job:com.acme.O'||l_orderkey||'#run()' WHEN '4-NOT SPECIFIED' THEN 'listener:kafka:o'||l_orderkey
  ELSE 'route:PUT /o/'||l_orderkey END"""


def raw_edges(v):
    gv = f"repo_id||':{v}'"
    return f"""
raw_{v} AS (
  SELECT {gv} AS gv, repo_id, {pk('l_partkey')} AS src,
    CASE WHEN is_lead AND l_returnflag = 'N' THEN 'unresolved:com.acme.S'||l_suppkey||'#call'
         WHEN is_lead THEN 'entity:com.acme.S'||l_suppkey ELSE {pk('lead_part')} END AS dst,
    CASE WHEN is_lead AND l_returnflag = 'N' THEN 'unresolved' WHEN is_lead THEN 'queries'
         WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'implements' WHEN l_returnflag = 'R' THEN 'overrides'
         ELSE 'calls' END AS type,
    CASE WHEN is_lead AND l_returnflag = 'N' THEN false WHEN is_lead THEN true ELSE l_discount >= 0.08 END AS inferred,
    CASE WHEN is_lead AND l_returnflag = 'N' THEN 'ambiguous' WHEN is_lead AND l_returnflag = 'A' THEN 'exact'
         WHEN is_lead THEN 'regex'
         ELSE (['exact','single_impl','regex','ambiguous'])[CAST(l_suppkey % 4 AS INT) + 1] END AS confidence,
    CASE WHEN is_lead AND l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'external_type' ELSE 'ambiguous_overload' END END AS reason,
    {pf('l_partkey')} AS site_file, l_linenumber AS site_line, {ORD}
  FROM li WHERE in_{v}
  UNION ALL
  SELECT {gv}, repo_id, {NODE}, {pk('lead_part')},
    CASE WHEN o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED') THEN 'triggers' ELSE 'handles' END,
    lead_part % 2 = 0, 'exact', NULL, {pf('lead_part')}, 0, {ORD} FROM li WHERE in_{v} AND is_lead
  UNION ALL
  SELECT {gv}, repo_id, 'entity:com.acme.S'||l_suppkey, 'table:nation_'||s_nationkey, 'maps_to', true,
    CASE WHEN s_acctbal > 5000 THEN 'exact' ELSE 'single_impl' END, NULL, {pf('l_partkey')}, 0, {ORD}
  FROM li JOIN supplier ON l_suppkey = s_suppkey WHERE in_{v} AND is_lead AND l_returnflag <> 'N' AND s_acctbal > 0)"""


def edges(v):
    return raw_edges(v) + f""",
first_{v} AS (SELECT *, row_number() OVER (PARTITION BY gv, src, dst, type ORDER BY {ORD}) AS rn FROM raw_{v}),
sites_{v} AS (SELECT gv, src, dst, type, string_agg(site_file||':'||site_line, ';' ORDER BY site_file, site_line) AS call_sites,
    min(struct_pack(f := site_file, l := site_line)) AS first_site
  FROM (SELECT DISTINCT gv, src, dst, type, site_file, site_line FROM raw_{v}) GROUP BY ALL),
edges_{v} AS (SELECT f.gv, f.repo_id, f.src, f.dst, f.type, f.inferred, f.confidence, f.reason, s.call_sites,
    s.first_site.f AS site_file, s.first_site.l AS site_line, {RANK.format('f.confidence')} AS rank
  FROM first_{v} f JOIN sites_{v} s USING (gv, src, dst, type) WHERE rn = 1)"""


def surfaces(v):
    gv = f"repo_id||':{v}'"
    return f"""
surf_{v} AS (
  SELECT {gv} AS gv, repo_id, {NODE} AS key, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'http_route'
      WHEN o_orderpriority = '3-MEDIUM' THEN 'scheduled_job' ELSE 'message_listener' END AS kind,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'httpMethod=GET;path=/o/'||l_orderkey
      WHEN '2-HIGH' THEN 'httpMethod=POST;path=/o/'||l_orderkey WHEN '3-MEDIUM' THEN 'cron=0 0 * * * *'
      ELSE 'broker=kafka;topic=o'||l_orderkey END AS attrs
  FROM li WHERE in_{v} AND is_lead AND o_orderpriority <> '5-LOW'
  UNION SELECT {gv}, repo_id, 'entity:com.acme.S'||l_suppkey, 'entity', 'fqcn=com.acme.S'||l_suppkey
  FROM li JOIN supplier ON l_suppkey = s_suppkey WHERE in_{v} AND is_lead AND l_returnflag <> 'N'
  UNION SELECT {gv}, repo_id, 'table:nation_'||s_nationkey, 'table', 'tableName=nation_'||s_nationkey
  FROM li JOIN supplier ON l_suppkey = s_suppkey WHERE in_{v} AND is_lead AND l_returnflag <> 'N' AND s_acctbal > 0)"""


def fv(v):
    shift = 3 if v == "head" else 0
    return f"""
fv_{v} AS (
  SELECT repo_id, 'a:'||repo_id AS analysis_id, repo_id||':{v}' AS gv, {pk('l_partkey')} AS function_key, {pf('l_partkey')} AS file_path,
    p_size + {shift} AS start_line, p_size + {shift + 9} AS end_line, 'sha256:'||sha256(p_name||':'||n) AS body_hash,
    'com.acme.'||p_type||CASE WHEN tax >= 0.08 THEN '[]' ELSE '' END AS return_type,
    p_type||CASE WHEN tax >= 0.08 THEN '[]' ELSE '' END AS simple_return,
    CASE WHEN disc <= 0.01 THEN 'public' ELSE 'private' END AS vis,
    CASE WHEN qmax >= 49 THEN ' final' ELSE '' END AS others, l_partkey
  FROM (SELECT repo_id, l_partkey, count(*) AS n, max(l_tax) AS tax, min(l_discount) AS disc, max(l_quantity) AS qmax
        FROM li WHERE in_{v} GROUP BY ALL) JOIN part ON l_partkey = p_partkey)"""


TOUCHED = f"""
touched AS (SELECT DISTINCT 'a:'||repo_id AS analysis_id, {pf('l_partkey')} AS file_path
  FROM li WHERE in_base <> in_head AND o_orderpriority <> '5-LOW')"""

SIG = "{s}.vis||{s}.others||' '||{s}.simple_return||' '||regexp_extract({k}, '#([^(]+)', 1)||'(Long id)'"
CHANGES = fv("base") + "," + fv("head") + "," + TOUCHED + f""",
head_side AS (SELECT h.* FROM fv_head h SEMI JOIN touched t ON h.analysis_id = t.analysis_id AND h.file_path = t.file_path),
base_side AS (SELECT b.* FROM fv_base b SEMI JOIN touched t ON b.analysis_id = t.analysis_id AND b.file_path = t.file_path),
both_sides AS (SELECT coalesce(b.analysis_id, h.analysis_id) AS analysis_id, coalesce(b.function_key, h.function_key) AS function_key,
    coalesce(b.repo_id, h.repo_id) AS repo_id,
    b.function_key IS NOT NULL AS has_base, h.function_key IS NOT NULL AS has_head,
    b.return_type IS NOT NULL AND h.return_type IS NOT NULL AND b.return_type <> h.return_type AS return_type_changed,
    b.vis IS NOT NULL AND h.vis IS NOT NULL AND b.vis <> h.vis AS visibility_changed,
    b.body_hash AS base_hash, h.body_hash AS head_hash, coalesce(h.file_path, b.file_path) AS file_path,
    coalesce({SIG.format(s='b', k='b.function_key')}, '') AS base_signature,
    coalesce({SIG.format(s='h', k='h.function_key')}, '') AS head_signature,
    b.start_line AS base_start, b.end_line AS base_end, h.start_line AS head_start, h.end_line AS head_end
  FROM base_side b FULL JOIN head_side h ON b.analysis_id = h.analysis_id AND b.function_key = h.function_key),
changes AS (SELECT *, analysis_id||'|'||function_key AS root_id, repo_id||':base' AS gv, repo_id||':head' AS head_gv,
    change_kind <> 'removed' AND NOT return_type_changed AS signature_compatible
  FROM (SELECT *, CASE WHEN NOT has_base THEN 'added' WHEN NOT has_head THEN 'removed'
          WHEN return_type_changed THEN 'signature_changed' WHEN base_hash <> head_hash THEN 'modified' END AS change_kind
        FROM both_sides) WHERE change_kind IS NOT NULL)"""


def walk(name, direction, roots="changes", cap=5, edge_table="edges_base"):
    """Unrolled level walk; leaves CTEs {name}_0..{name}_cap and {name}."""
    near, far = ("dst", "src") if direction == "reverse" else ("src", "dst")
    types = "'calls','implements','overrides'" if direction == "reverse" else "'calls'"
    out = [f"""
{name}_hops AS MATERIALIZED (SELECT gv, {near} AS near, {far} AS far, rank, inferred FROM {edge_table} WHERE type IN ({types}) AND src <> dst),
{name}_0 AS MATERIALIZED (SELECT DISTINCT root_id, gv, function_key AS node, 0 AS depth, 0 AS rank, false AS inferred FROM {roots})"""]
    for d in range(1, cap + 1):
        seen = " UNION ALL ".join(f"SELECT root_id, gv, node FROM {name}_{i}" for i in range(d))
        out.append(f"""
{name}_{d} AS MATERIALIZED (SELECT root_id, gv, node, {d} AS depth, w // 2 AS rank, w % 2 = 1 AS inferred FROM (
  SELECT f.root_id, f.gv, h.far AS node, min(greatest(f.rank, h.rank) * 2 + CASE WHEN f.inferred OR h.inferred THEN 1 ELSE 0 END) AS w
  FROM {name}_{d-1} f JOIN {name}_hops h ON f.gv = h.gv AND f.node = h.near GROUP BY 1, 2, 3) c
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.root_id = c.root_id AND s.gv = c.gv AND s.node = c.node))""")
    out.append(f"\n{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_{i}" for i in range(cap + 1)) + ")")
    return ",".join(out)


DISPLAY = ("CASE WHEN regexp_full_match({k}, 'fn:([^#]+)#([^(]+)\\((.*)\\)') THEN "
           "regexp_extract({k}, 'fn:(?:.*\\.)?([^#.]+)#', 1)||'.'||regexp_extract({k}, '#([^(]+)\\(', 1)||'('||"
           "regexp_replace(regexp_extract({k}, '\\((.*)\\)', 1), '[A-Za-z0-9_.]*\\.', '', 'g')||')' ELSE {k} END")

SQL = {}


def define(name, body, *ctes):
    SQL[name] = ("WITH " + ",".join(ctes) + "\n" if ctes else "") + body


# --- change detection -------------------------------------------------------------------------------
define("touched_files", "SELECT analysis_id, file_path FROM touched", LINES, TOUCHED)
define("changed_functions", """SELECT analysis_id, function_key, change_kind, file_path FROM changes""", LINES, CHANGES)
define("signature_diff", """SELECT analysis_id, function_key, base_signature, head_signature, return_type_changed,
  visibility_changed, false AS params_changed, 0 AS throws_added, signature_compatible FROM changes""", LINES, CHANGES)


# --- graph and walks ----------------------------------------------------------------------------------
EB, EH, SB = edges("base"), edges("head"), surfaces("base")
define("edge_collapse", "SELECT gv, src, dst, type, inferred, confidence, reason, call_sites FROM edges_base", LINES, EB)
define("surface_collapse", "SELECT gv, repo_id, key, kind, attrs FROM surf_base", LINES, SB)
define("adjacency", """SELECT 'in' AS side, e.gv, src, dst, type FROM edges_base e SEMI JOIN changes c ON e.gv = c.gv AND e.dst = c.function_key
  WHERE type IN ('calls','implements','overrides')
  UNION ALL SELECT 'out', e.gv, src, dst, type FROM edges_base e SEMI JOIN changes c ON e.gv = c.gv AND e.src = c.function_key""",
       LINES, EB, CHANGES)

CALLERS = f"""
back AS (SELECT * FROM edges_base WHERE type IN ('calls','implements','overrides')),
hop1 AS (SELECT c.root_id, c.gv, c.function_key AS root_node, b.src AS caller, 1 AS hops, b.rank, b.inferred, b.type, b.dst AS via, b.site_file, b.site_line
  FROM changes c JOIN back b ON b.gv = c.gv AND b.dst = c.function_key WHERE b.src <> c.function_key),
hop2 AS (SELECT h.root_id, h.gv, h.root_node, b.src, 2, greatest(b.rank, h.rank), b.inferred OR h.inferred, b.type, b.dst, b.site_file, b.site_line
  FROM hop1 h JOIN back b ON b.gv = h.gv AND b.dst = h.caller WHERE b.src <> h.root_node AND b.src <> h.caller),
callers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id, caller ORDER BY hops, rank, inferred, type, via) AS rn
  FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)) WHERE rn = 1),
totals AS (SELECT root_id, count(*) AS caller_total, false AS truncated, count(*) FILTER (rank = 3) AS ambiguous_callers FROM callers GROUP BY 1)"""
define("direct_callers", f"""SELECT * FROM (SELECT k.root_id, row_number() OVER (PARTITION BY k.root_id ORDER BY signature_compatible, hops, rank, caller) AS position,
    caller AS key, {DISPLAY.format(k='caller')} AS display_name, CAST(hops AS BIGINT) AS hops, k.site_file AS file_path, CAST(k.site_line AS BIGINT) AS line,
    CASE type WHEN 'calls' THEN 'calls this method' WHEN 'implements' THEN 'implements this interface method' ELSE 'overrides this method' END AS usage,
    signature_compatible, {NAMES.format('rank')} AS confidence, inferred FROM callers k JOIN changes USING (root_id))""",
       LINES, EB, CHANGES, CALLERS)
define("direct_caller_totals", "SELECT root_id, caller_total, truncated, ambiguous_callers FROM totals", LINES, EB, CHANGES, CALLERS)

REV, FWD = walk("rev", "reverse"), walk("fwd", "forward")
define("level_walk_reverse", "SELECT root_id, node, CAST(depth AS BIGINT) AS depth, CAST(rank AS BIGINT) AS rank, inferred FROM rev", LINES, EB, CHANGES, REV)
define("level_walk_forward", "SELECT root_id, node, CAST(depth AS BIGINT) AS depth, CAST(rank AS BIGINT) AS rank, inferred FROM fwd", LINES, EB, CHANGES, FWD)
META = """
meta AS (SELECT root_id, count(*) AS nodes_visited FROM rev GROUP BY 1),
capped AS (SELECT DISTINCT f.root_id FROM rev_5 f JOIN rev_hops h ON f.gv = h.gv AND f.node = h.near
  WHERE NOT EXISTS (SELECT 1 FROM rev v WHERE v.root_id = f.root_id AND v.gv = f.gv AND v.node = h.far))"""
define("walk_meta", "SELECT m.root_id, 5 AS max_depth, nodes_visited, c.root_id IS NOT NULL AS depth_cap_hit FROM meta m LEFT JOIN capped c USING (root_id)",
       LINES, EB, CHANGES, REV, META)
define("entrypoints", """SELECT root_id, e.src AS key, s.kind, min((depth + 1) * 2 + CASE WHEN v.inferred OR e.inferred THEN 1 ELSE 0 END) // 2 AS min_hops,
    min((depth + 1) * 2 + CASE WHEN v.inferred OR e.inferred THEN 1 ELSE 0 END) % 2 = 1 AS via_inferred_edge
  FROM rev v JOIN edges_base e ON e.gv = v.gv AND e.dst = v.node AND e.type IN ('handles','triggers') JOIN surf_base s ON s.gv = e.gv AND s.key = e.src
  GROUP BY 1, 2, 3""", LINES, EB, SB, CHANGES, REV)
DATA = f"""
tabs AS (SELECT gv, src AS entity, dst, inferred, rank FROM (SELECT *, row_number() OVER (PARTITION BY gv, src ORDER BY dst) AS rn
  FROM edges_base WHERE type = 'maps_to') WHERE rn = 1),
terminals AS (SELECT v.root_id, coalesce(t.dst, q.dst) AS key, CASE WHEN t.dst IS NULL THEN 'entity' ELSE 'table' END AS kind,
    CASE WHEN regexp_matches(v.node, '#(save|delete|persist)') THEN 'write' ELSE 'read' END AS access,
    v.inferred OR q.inferred OR coalesce(t.inferred, false) AS via, greatest(v.rank, q.rank, coalesce(t.rank, 0)) AS rank
  FROM fwd v JOIN edges_base q ON q.gv = v.gv AND q.src = v.node AND q.type = 'queries' LEFT JOIN tabs t ON t.gv = q.gv AND t.entity = q.dst),
data AS (SELECT root_id, key, kind, CASE WHEN count(DISTINCT access) > 1 THEN 'read_write' ELSE min(access) END AS access,
    bool_or(via) AS via_inferred_edge, {NAMES.format('max(rank)')} AS confidence FROM terminals GROUP BY 1, 2, 3)"""
define("data_surfaces", "SELECT * FROM data", LINES, EB, CHANGES, FWD, DATA)
define("now_depends_on", f"""SELECT c.root_id, h.dst AS key, {DISPLAY.format(k='h.dst')} AS display_name, h.type,
    NOT EXISTS (SELECT 1 FROM edges_base b WHERE b.gv = c.gv AND b.src = c.function_key AND b.dst = h.dst) AS is_new, h.confidence, h.inferred
  FROM changes c JOIN edges_head h ON h.gv = c.head_gv AND h.src = c.function_key""", LINES, EB, EH, CHANGES)
AMBIG = """
ambig AS (SELECT c.root_id, coalesce(t.ambiguous_callers, 0) + coalesce(a.n, 0) AS ambiguous_edges_on_path FROM changes c
  LEFT JOIN totals t USING (root_id) LEFT JOIN (SELECT root_id, count(*) AS n FROM data WHERE confidence = 'ambiguous' GROUP BY 1) a USING (root_id))"""
define("ambiguous_on_path", "SELECT * FROM ambig", LINES, EB, CHANGES, CALLERS, FWD, DATA, AMBIG)
SQL["reverse_reachable"] = f"""WITH RECURSIVE {LINES}, {EB},
links AS MATERIALIZED (SELECT DISTINCT gv, src, dst FROM edges_base WHERE src <> dst),
reach(gv, node, distance) USING KEY (gv, node) AS (
  SELECT DISTINCT gv, dst, 0 FROM edges_base WHERE type = 'maps_to'
  UNION SELECT DISTINCT r.gv, l.src, r.distance + 1 FROM reach r JOIN links l ON l.gv = r.gv AND l.dst = r.node
    WHERE NOT EXISTS (SELECT 1 FROM recurring.reach k WHERE k.gv = r.gv AND k.node = l.src))
SELECT gv, node, CAST(distance AS BIGINT) AS distance FROM reach"""
SQL["is_ancestor"] = """WITH RECURSIVE pairs AS (SELECT DISTINCT o_orderkey AS head, unnest([o_orderkey // 4, o_orderkey // 5]) AS base FROM orders),
up(head, node) AS (SELECT DISTINCT head, head FROM pairs UNION SELECT head, unnest([node // 2, node // 3]) FROM up WHERE node > 0)
SELECT 'history' AS repo_id, 'c'||base AS base_sha, 'c'||p.head AS head_sha, u.node IS NOT NULL AS is_ancestor
FROM pairs p LEFT JOIN up u ON u.head = p.head AND u.node = p.base"""

# --- diff text and contexts ---------------------------------------------------------------------------
HUNKS = f"""
texts AS (SELECT 'a:'||repo_id AS analysis_id, {pf('l_partkey')} AS file_path, a, b, n FROM (
  SELECT repo_id, l_partkey, count(*) AS n, CAST(min(l_quantity) AS BIGINT) AS a, CAST(max(l_quantity) AS BIGINT) AS b FROM li GROUP BY ALL)),
text_lines AS (SELECT analysis_id, file_path, unnest(string_split(txt, chr(10))) AS line, generate_subscripts(string_split(txt, chr(10)), 1) AS line_no
  FROM (SELECT analysis_id, file_path, 'diff --git a/'||file_path||' b/'||file_path||chr(10)||'--- a/'||file_path||chr(10)||'+++ b/'||file_path||chr(10)||
    '@@ -'||a||',3 +'||(a+3)||',3 @@'||chr(10)||'-base '||n||chr(10)||chr(10)||'+head '||n||chr(10)||'@@ -'||b||' +'||b||' @@ tail'||chr(10)||'+'||b||chr(10) AS txt FROM texts)),
numbered AS MATERIALIZED (SELECT *, sum(CASE WHEN line LIKE '@@%' THEN 1 ELSE 0 END) OVER (PARTITION BY analysis_id, file_path ORDER BY line_no) AS hunk_no FROM text_lines),
hunks AS MATERIALIZED (SELECT analysis_id, file_path, hunk_no, TRY_CAST(regexp_extract(h, '^@@ -(\\d+)', 1) AS BIGINT) AS old_start,
    TRY_CAST(regexp_extract(h, '\\+(\\d+)', 1) AS BIGINT) AS new_start, coalesce(TRY_CAST(regexp_extract(h, '^@@ -\\d+,(\\d+)', 1) AS BIGINT), 1) AS old_len,
    coalesce(TRY_CAST(regexp_extract(h, '\\+\\d+,(\\d+)', 1) AS BIGINT), 1) AS new_len, lines, block
  FROM (SELECT analysis_id, file_path, hunk_no, max(line) FILTER (line LIKE '@@%') AS h, string_agg(line, '|' ORDER BY line_no) FILTER (line <> '') AS lines,
    string_agg(line, chr(10) ORDER BY line_no) FILTER (line <> '') AS block
    FROM numbered GROUP BY 1, 2, 3))"""
define("diff_hunks", """SELECT analysis_id, file_path, CAST(hunk_no AS BIGINT) AS hunk_no, old_start, old_start + old_len - 1 AS old_end, new_start,
  new_start + new_len - 1 AS new_end, lines FROM hunks""", LINES, HUNKS)


METHOD_DIFF = """
kept AS MATERIALIZED (SELECT c.root_id, h.hunk_no, h.block FROM changes c JOIN hunks h USING (analysis_id, file_path)
  WHERE (h.hunk_no = 0 OR (old_start <= base_end AND base_start <= old_start + old_len - 1) OR (new_start <= head_end AND head_start <= new_start + new_len - 1))),
mdiff AS (SELECT c.analysis_id, c.function_key, c.root_id, coalesce(t.txt, '') AS source_diff FROM changes c LEFT JOIN
  (SELECT root_id, string_agg(block, chr(10) ORDER BY hunk_no) AS txt FROM kept GROUP BY 1) t USING (root_id))"""


define("method_diffs", "SELECT analysis_id, function_key, source_diff FROM mdiff", LINES, CHANGES, HUNKS, METHOD_DIFF)
HEADER = f"""
rates AS (SELECT gv, count(*) FILTER (type = 'unresolved') / count(*) AS unresolved_rate FROM edges_base GROUP BY 1),
header AS (SELECT c.root_id, c.repo_id, 'acme' AS owner, n_name AS name, CAST(n_nationkey AS BIGINT) AS pr_number, c.function_key,
    {DISPLAY.format(k='c.function_key')} AS display_name, change_kind, file_path, base_signature, head_signature, return_type_changed, visibility_changed,
    source_diff, coalesce(caller_total, 0) AS caller_total, coalesce(truncated, false) AS truncated, 5 AS max_depth, k.root_id IS NOT NULL AS depth_cap_hit,
    nodes_visited, round(coalesce(unresolved_rate, 0), 6) AS unresolved_rate, ambiguous_edges_on_path, coalesce(pe.n, 0) AS parse_errors
  FROM changes c JOIN nation ON c.repo_id = 'r'||n_nationkey LEFT JOIN rates USING (gv) LEFT JOIN totals USING (root_id) LEFT JOIN mdiff m USING (root_id)
  LEFT JOIN meta USING (root_id) LEFT JOIN ambig USING (root_id) LEFT JOIN capped k USING (root_id)
    LEFT JOIN (SELECT t.analysis_id, count(*) AS n FROM touched t JOIN fv_head h USING (analysis_id, file_path) WHERE h.end_line > 50 GROUP BY 1) pe ON pe.analysis_id = c.analysis_id)"""
ALL_PARTS = (LINES, EB, EH, SB, CHANGES, CALLERS, REV, FWD, META, DATA, AMBIG, HUNKS, METHOD_DIFF, HEADER)
define("context_objects", "SELECT * FROM header", *ALL_PARTS)


# --- graph construction ---------------------------------------------------------------------------------
def tfile(k):
    return f"CASE WHEN ({k}) % 5 = 4 THEN 'target/generated-sources/' ELSE '' END||'src/main/java/com/acme/T'||({k})||'.java'"


FNS = f"""
pp AS (SELECT *, p_partkey // 8 AS k, p_partkey % 8 AS slot FROM part),
fns AS (SELECT *, 'fn:'||fqcn||'#'||mname||'('||ptypes||')' AS function_key FROM (
  SELECT 'g'||(k % 4) AS gv, {tfile('k')} AS file_path, k % 5 <> 4 AS inside, slot * 20 + 1 AS start_line, 5 AS start_col, slot * 20 + 15 AS end_line, 6 AS end_col,
    'com.acme.T'||k AS fqcn, 'T'||k AS class_name, CASE WHEN p_size = 50 THEN '<init>' ELSE 'op'||(slot // 2) END AS mname, p_size = 50 AS ctor,
    'java.lang.'||CASE WHEN slot % 2 = 0 THEN 'Long' ELSE 'Integer' END||CASE WHEN p_size % 2 = 1 THEN ','||CASE WHEN k % 2 = 0 THEN 'java.util.List' ELSE 'List' END||
      CASE WHEN p_size > 25 THEN '[]' ELSE '' END ELSE '' END AS ptypes, 1 + p_size % 2 AS arity, p_size % 2 AS unresolved_params,
    CASE WHEN p_size = 50 THEN 'void' ELSE 'com.acme.'||p_type END AS return_type, p_name, p_type, p_size, k, slot, k % 3 = 0 AS iface,
    p_size <> 50 AND p_type = 'PROMO' AS is_abstract, CASE WHEN p_type = 'PROMO' THEN 'public abstract' ELSE 'public' END AS modifiers FROM pp
  UNION ALL
  SELECT 'g'||(k % 4), {tfile('k')}, k % 5 <> 4, slot * 20 + 4, 9, slot * 20 + 7, 10, 'com.acme.T'||k||'$'||slot, 'T'||k||'$'||slot, 'run', false, '', 0, 0,
    'void', p_name, 'NONE', 0, k, slot, false, false, 'public' FROM pp WHERE p_type = 'LARGE')),
tps AS (SELECT DISTINCT k, 'g'||(k % 4) AS gv, 'com.acme.T'||k AS fqcn, k % 3 = 0 AS iface, k % 5 <> 4 AS inside, {tfile('k')} AS file_path FROM pp)"""
UPS = """
up(gv, fqcn, anc, distance) AS (SELECT 'g'||(k % 4), k, (k // 8) * 4 + k % 4, 1 FROM (SELECT DISTINCT p_partkey // 8 AS k FROM part) WHERE k >= 4
  UNION SELECT gv, fqcn, (anc // 8) * 4 + anc % 4, distance + 1 FROM up WHERE anc >= 4),
ups AS (SELECT gv, 'com.acme.T'||fqcn AS fqcn, 'com.acme.T'||anc AS ancestor_fqcn, min(distance) AS distance FROM up GROUP BY ALL)"""
SITES = f"""
sites0 AS (SELECT l_partkey AS p, ((l_partkey // 64) * 4 + (l_partkey // 8) % 4) * 8 + l_suppkey % 8 AS t, l_suppkey AS s, l_linenumber AS ln, CAST(floor(l_quantity) AS INT) AS q, month(l_shipdate) AS m FROM lineitem),
sites AS (SELECT 'g'||((p // 8) % 4) AS gv, {tfile('p // 8')} AS file_path, (p // 8) % 5 <> 4 AS inside, (p % 8) * 20 + 1 + ln AS line, q AS col,
    CASE ln WHEN 7 THEN 'constructor' WHEN 6 THEN 'method_ref' ELSE 'method' END AS target_kind, m <> 1 AS is_bound, m IN (1, 2) AS no_position,
    {tfile('t // 8')} AS rfile, (t // 8) % 5 <> 4 AS rinside, (t % 8) * 20 + 1 AS rline, CASE WHEN q = 50 THEN 4 ELSE 5 END AS rcol,
    CASE WHEN ln = 1 THEN NULL ELSE 'com.acme.T'||(t // 8) END AS scope_type, 'op'||((t % 8) // 2) AS name, 1 + s % 2 AS arity, s % 3 = 0 AS ambiguity FROM sites0),
points AS (SELECT DISTINCT gv, file_path, line, col FROM sites),
owner AS (SELECT gv, file_path, line, col, function_key FROM (SELECT q.*, f.function_key, row_number() OVER (PARTITION BY q.gv, q.file_path, q.line, q.col
    ORDER BY f.end_line - f.start_line, -f.start_line) AS rn FROM points q JOIN fns f ON f.gv = q.gv AND f.file_path = q.file_path
    AND (q.line > f.start_line OR (q.line = f.start_line AND q.col >= f.start_col)) AND (q.line < f.end_line OR (q.line = f.end_line AND q.col <= f.end_col))) WHERE rn = 1),
cands AS (SELECT gv, fqcn AS scope_type, mname AS name, arity, count(*) AS n, min(function_key) AS only_key, min(inside::INT) = 1 AS only_inside,
    string_agg(DISTINCT fqcn||'.'||mname||'('||replace(ptypes, ',', ', ')||')', ';' ORDER BY fqcn||'.'||mname||'('||replace(ptypes, ',', ', ')||')') AS sigs
  FROM fns WHERE NOT ctor GROUP BY 1, 2, 3, 4),
classed0 AS (SELECT s.*, o.function_key, f.function_key AS pos_key, c.n, c.only_key, c.only_inside, c.sigs,
    NOT s.is_bound AND s.target_kind = 'method' AND coalesce(c.n, 0) = 1 AS single
  FROM sites s JOIN owner o USING (gv, file_path, line, col) LEFT JOIN fns f ON NOT s.no_position AND f.gv = s.gv AND f.file_path = s.rfile AND f.start_line = s.rline AND f.start_col = s.rcol
  LEFT JOIN cands c ON c.gv = s.gv AND c.scope_type = s.scope_type AND c.name = s.name AND c.arity = s.arity WHERE s.inside),
classed AS (SELECT *, CASE outcome WHEN 'unresolved' THEN 'unresolved:'||coalesce(scope_type, '')||'#'||CASE WHEN target_kind = 'constructor' THEN '<init>' ELSE name END
      WHEN 'calls' THEN CASE WHEN is_bound THEN coalesce(pos_key, 'fn:com.acme.Missing#lost()') ELSE only_key END END AS dst,
    CASE outcome WHEN 'unresolved' THEN 'ambiguous' WHEN 'calls' THEN CASE WHEN is_bound THEN 'exact' ELSE 'single_impl' END END AS confidence,
    CASE WHEN outcome = 'unresolved' THEN CASE WHEN ambiguity THEN 'ambiguous_overload' ELSE 'external_type' END END AS reason,
    CASE WHEN outcome = 'unresolved' AND ambiguity AND target_kind = 'method' THEN coalesce(sigs, '') ELSE '' END AS candidates,
    outcome = 'calls' AND is_bound AND pos_key IS NULL AS index_miss
  FROM (SELECT *, CASE WHEN (is_bound AND NOT no_position AND rinside) OR (single AND only_inside) THEN 'calls' WHEN is_bound OR single THEN 'external' ELSE 'unresolved' END AS outcome FROM classed0))"""
define("build_functions", """SELECT gv, file_path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, function_key, class_name, return_type,
  'sha256:'||sha256(p_name) AS body_hash, modifiers, is_abstract, iface AS is_interface_method, unresolved_params, CASE WHEN p_type IN ('LARGE','NONE') THEN 0 ELSE 1 END AS annotations FROM fns""", FNS)
define("qualify_types", """SELECT gv, file_path, CAST(start_line AS BIGINT) AS start_line, pos - 1 AS pos, t AS type_name, pos = 1 AS is_resolved FROM (
  SELECT gv, file_path, start_line, unnest(string_split(ptypes, ',')) AS t, generate_subscripts(string_split(ptypes, ','), 1) AS pos FROM fns WHERE ptypes <> '')""", FNS)
define("enclosing_callable", "SELECT gv, file_path, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, function_key FROM owner", FNS, SITES)
define("declaring_type", "SELECT gv, file_path, CAST(start_line AS BIGINT) AS line, CAST(start_col AS BIGINT) AS col, fqcn FROM fns", FNS)
define("number_anonymous", f"""SELECT gv, file_path, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, top||'$'||row_number() OVER (PARTITION BY gv, file_path, top ORDER BY line, col) AS fqcn FROM (
  SELECT DISTINCT 'g'||((l_partkey // 8) % 4) AS gv, {tfile('l_partkey // 8')} AS file_path, 'com.acme.T'||(l_partkey // 8) AS top, (l_partkey % 8) * 20 + 1 + l_linenumber AS line,
    CAST(floor(l_quantity) AS INT) AS col FROM lineitem WHERE l_returnflag = 'R')""")
define("classify_calls", """SELECT gv, function_key, outcome, dst, confidence, reason, candidates, count(*) AS n, count(*) FILTER (index_miss) AS misses
  FROM classed GROUP BY 1, 2, 3, 4, 5, 6, 7""", FNS, SITES)
define("bind_by_elimination", """SELECT s.gv, s.scope_type, s.name, c.only_key AS dst, count(*) AS n FROM sites s JOIN cands c USING (gv, scope_type, name, arity)
  WHERE NOT s.is_bound AND s.target_kind = 'method' AND c.n = 1 GROUP BY 1, 2, 3, 4""", FNS, SITES)


def define_rec(name, body, *ctes):
    SQL[name] = "WITH RECURSIVE " + ",".join(ctes) + "\n" + body


define_rec("ancestor_closure", "SELECT gv, fqcn, ancestor_fqcn, CAST(distance AS BIGINT) AS distance FROM ups", UPS)
INH = """
inh AS (SELECT a.gv, a.function_key AS src, b.function_key AS dst, CASE WHEN t.iface THEN 'implements' ELSE 'overrides' END AS type, a.file_path, a.start_line
  FROM fns a JOIN ups u ON u.gv = a.gv AND u.fqcn = a.fqcn JOIN tps t ON t.gv = u.gv AND t.fqcn = u.ancestor_fqcn AND t.inside
  JOIN fns b ON b.gv = u.gv AND b.fqcn = u.ancestor_fqcn AND b.mname = a.mname AND b.arity = a.arity AND NOT b.ctor
  WHERE NOT a.ctor AND a.inside AND string_split(a.ptypes, ',')[1] = string_split(b.ptypes, ',')[1])"""
define_rec("inheritance_edges", "SELECT gv, src, dst, type, CAST(start_line AS BIGINT) AS line FROM inh", FNS, UPS, INH)
define("selector_keys", """SELECT f.gv, f.function_key, f.k % 7 = 0 AS is_primary, f.k % 7 = 1 AS is_qualified FROM fns f JOIN tps t ON t.gv = f.gv AND t.fqcn = f.fqcn
  WHERE f.k % 7 IN (0, 1)""", FNS)
LIT = """
raw_calls AS (SELECT gv, function_key AS src, dst, CASE WHEN outcome = 'calls' THEN 'calls' ELSE 'unresolved' END AS type, confidence, reason, file_path, line, col
  FROM classed WHERE outcome <> 'external'),
lit_calls AS (SELECT gv, src, dst, type, false AS inferred, arg_min(confidence, ord) AS confidence, arg_min(reason, ord) AS reason, count(DISTINCT (file_path, line)) AS sites
  FROM (SELECT *, row_number() OVER (PARTITION BY gv, src, dst, type ORDER BY file_path, line, col, confidence, coalesce(reason, '')) AS ord FROM raw_calls) GROUP BY 1, 2, 3, 4),
impls AS (SELECT DISTINCT i.gv, i.dst AS via, i.src AS impl, coalesce(f.k % 7 = 0 AND f.mname <> 'run', false) AS p, coalesce(f.k % 7 = 1 AND f.mname <> 'run', false) AS q
  FROM inh i JOIN fns f ON f.gv = i.gv AND f.function_key = i.src WHERE i.type = 'implements'),
chosen AS (SELECT gv, via, impl, CASE WHEN n = 1 OR np = 1 OR nq = 1 THEN 'single_impl' ELSE 'ambiguous' END AS confidence FROM (
  SELECT *, count(*) OVER w AS n, count(*) FILTER (p) OVER w AS np, count(*) FILTER (q) OVER w AS nq FROM impls WINDOW w AS (PARTITION BY gv, via))
  WHERE n = 1 OR (np = 1 AND p) OR (np <> 1 AND nq = 1 AND q) OR (np <> 1 AND nq <> 1)),
disp AS (SELECT DISTINCT r.gv, r.src, c.impl AS dst, c.confidence, c.via, r.file_path, r.line FROM raw_calls r JOIN chosen c ON c.gv = r.gv AND c.via = r.dst WHERE r.type = 'calls')"""
define_rec("dispatch_edges", "SELECT gv, src, dst, confidence, via, count(*) AS sites FROM disp GROUP BY 1, 2, 3, 4, 5", FNS, SITES, UPS, INH, LIT)
MARKS = r"""
marks AS (SELECT gv, fqcn, mname, arity, function_key, iface, inside, k, p_name, p_size, p_type FROM fns WHERE NOT ctor AND p_type IN ('ECONOMY','STANDARD','SMALL','MEDIUM')),
slots AS (SELECT *, CASE WHEN p_type IN ('ECONOMY','STANDARD') THEN 'route' WHEN p_type = 'SMALL' THEN 'job' ELSE 'listener' END AS slot FROM marks),
own AS (SELECT gv, fqcn, function_key, slot, p_name, p_size, p_type, fqcn AS decl, inside, false AS inherited FROM slots WHERE NOT iface),
inherited AS (SELECT gv, fqcn, function_key, slot, p_name, p_size, p_type, decl, inside, true AS inherited FROM (
  SELECT c.gv, c.fqcn, c.function_key, c.inside, s.slot, s.p_name, s.p_size, s.p_type, s.fqcn AS decl,
    row_number() OVER (PARTITION BY c.gv, c.function_key, s.slot ORDER BY u.distance, s.fqcn, s.function_key) AS rn
  FROM fns c JOIN ups u ON u.gv = c.gv AND u.fqcn = c.fqcn JOIN slots s ON s.gv = u.gv AND s.fqcn = u.ancestor_fqcn AND s.mname = c.mname AND s.arity = c.arity
  WHERE NOT c.ctor AND NOT c.iface AND NOT EXISTS (SELECT 1 FROM own o WHERE o.gv = c.gv AND o.function_key = c.function_key AND o.slot = s.slot)) WHERE rn = 1),
declared AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM inherited) WHERE inside),
consts AS (SELECT 'com.acme.T'||k AS fqcn, p_name AS field, min(CASE WHEN p_size > 35 THEN NULL ELSE '/c/'||replace(p_name, ' ', '-') END) AS literal FROM pp GROUP BY 1, 2),
route0 AS (SELECT d.*, CASE WHEN p_type = 'ECONOMY' THEN 'GET' ELSE 'PUT' END AS verb,
    CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size > 40 THEN '${base}/x' ELSE replace(p_name, ' ', '/') END
         ELSE coalesce(ltrim(literal, '/'), 'Api.PATH_'||upper(replace(p_name, ' ', '_'))) END AS tail,
    p_type = 'STANDARD' AND literal IS NULL OR p_type = 'ECONOMY' AND p_size > 40 AS unsure,
    CASE WHEN CAST(regexp_extract(d.fqcn, '^com.acme.T(\d+)$', 1) AS BIGINT) % 2 = 1 THEN '/t'||regexp_extract(d.fqcn, 'T(\d+)$', 1) ELSE '' END AS prefix
  FROM declared d LEFT JOIN consts c ON c.fqcn = d.decl AND c.field = d.p_name WHERE slot = 'route'),
routed AS (SELECT *, prefix||'/'||tail AS path, 'route:'||verb||' '||prefix||'/'||tail AS key, CASE WHEN unsure THEN 'ambiguous' ELSE 'exact' END AS confidence FROM route0),
timed AS (SELECT gv, CASE WHEN slot = 'job' THEN replace(function_key, 'fn:', 'job:') WHEN p_size > 25 THEN 'listener:kafka:'||replace(function_key, 'fn:', '') ELSE 'listener:kafka:t.'||p_name END AS key,
    CASE WHEN slot = 'job' THEN 'cron=0 '||p_size||' * * * *' WHEN p_size > 25 THEN 'kafka:' ELSE 'kafka:t.'||p_name END AS attrs, function_key, inherited, slot, p_size, p_name
  FROM declared WHERE slot <> 'route')"""
define_rec("routes", "SELECT gv, key, verb, path, confidence, function_key, inherited FROM routed", FNS, UPS, MARKS)
define_rec("jobs_listeners", "SELECT gv, key, attrs, function_key, inherited FROM timed", FNS, UPS, MARKS)
REPO = """
markers AS (SELECT gv, fqcn, k, CASE WHEN k % 12 = 0 THEN 'com.acme.OrderLine'||k ELSE 'com.acme.T'||(k + 4) END AS entity FROM tps WHERE iface AND k % 6 = 0),
holders AS (SELECT gv, fqcn AS holder, entity FROM markers UNION SELECT m.gv, u.ancestor_fqcn, entity FROM markers m JOIN ups u USING (gv, fqcn)),
qe AS (SELECT DISTINCT h.gv, f.function_key AS src, 'entity:'||entity AS dst, CASE WHEN p_type = 'PROMO' THEN 'regex' ELSE 'exact' END AS confidence, f.file_path, f.start_line
  FROM holders h JOIN fns f ON f.gv = h.gv AND f.fqcn = h.holder WHERE NOT f.ctor AND f.inside),
ents AS (SELECT DISTINCT m.gv, 'entity:'||entity AS entity, entity AS fqcn, 'table:'||tab AS tab, tab AS name, CASE WHEN explicit THEN 'exact' ELSE 'single_impl' END AS confidence FROM (
  SELECT m.*, t.k IS NOT NULL AND t.k % 11 = 0 AS explicit, CASE WHEN t.k % 11 = 0 THEN 't'||t.k WHEN m.k % 12 = 0 THEN 'order_line'||m.k ELSE 't'||(m.k + 4) END AS tab
  FROM markers m LEFT JOIN tps t ON t.gv = m.gv AND t.fqcn = m.entity) m)"""
define_rec("repository_edges", "SELECT h.gv, f.function_key AS src, 'entity:'||entity AS dst, CASE WHEN p_type = 'PROMO' THEN 'regex' ELSE 'exact' END AS confidence"
           " FROM (SELECT DISTINCT m.gv, m.fqcn AS marker, h.holder, m.entity FROM markers m JOIN (SELECT gv, fqcn AS marker, fqcn AS holder FROM markers UNION ALL"
           " SELECT gv, fqcn, ancestor_fqcn FROM ups) h ON h.gv = m.gv AND h.marker = m.fqcn) h JOIN fns f ON f.gv = h.gv AND f.fqcn = h.holder WHERE NOT f.ctor AND f.inside", FNS, UPS, REPO)
define_rec("entity_tables", 'SELECT gv, entity, tab AS "table", confidence FROM ents', FNS, UPS, REPO)
GRAPH = """
merged AS (
  SELECT gv, src, dst, type, 0 AS stage, '' AS via, inferred, confidence, reason FROM lit_calls
  UNION ALL SELECT gv, src, dst, 'calls', 5, via, true, confidence, NULL FROM disp),
merged_sites AS (SELECT gv, src, dst, type, file_path, line FROM raw_calls UNION SELECT gv, src, dst, 'calls', file_path, line FROM disp),
code AS (SELECT m.*, s.sites FROM (SELECT gv, src, dst, type, arg_min(inferred, o) AS inferred, arg_min(confidence, o) AS confidence, arg_min(reason, o) AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY gv, src, dst, type ORDER BY stage, f, l, via) AS o FROM (SELECT m.*, d.file_path AS f, d.line AS l FROM merged m
      LEFT JOIN (SELECT gv, src, dst, via, min(file_path) AS file_path, min(line) AS line FROM disp GROUP BY 1, 2, 3, 4) d ON m.stage = 5 AND d.gv = m.gv AND d.src = m.src AND d.dst = m.dst AND d.via = m.via))
    GROUP BY 1, 2, 3, 4) m
  JOIN (SELECT gv, src, dst, type, count(*) AS sites FROM merged_sites GROUP BY 1, 2, 3, 4) s USING (gv, src, dst, type)),
g AS (SELECT gv, src, dst, type, inferred, confidence, reason, sites FROM code
  UNION ALL SELECT gv, src, dst, type, false, 'exact', NULL, count(DISTINCT (file_path, start_line)) FROM inh GROUP BY 1, 2, 3, 4
  UNION ALL SELECT gv, key, function_key, 'handles', true, confidence, NULL, 1 FROM routed
  UNION ALL SELECT gv, key, function_key, 'triggers', true, 'exact', NULL, 1 FROM timed
  UNION ALL SELECT gv, src, dst, 'queries', true, min(confidence), NULL, count(DISTINCT (file_path, start_line)) FROM qe GROUP BY 1, 2, 3
  UNION ALL SELECT gv, entity, tab, 'maps_to', true, confidence, NULL, 1 FROM ents)"""
ALLG = (FNS, SITES, UPS, INH, LIT, MARKS, REPO, GRAPH)
define_rec("build_graph", "SELECT * FROM g", *ALLG)
define_rec("graph_surfaces", """SELECT DISTINCT gv, key, 'http_route' AS kind, 'httpMethod='||verb||';path='||path AS attrs FROM routed
  UNION SELECT gv, key, 'scheduled_job', attrs FROM timed WHERE slot = 'job'
  UNION SELECT gv, key, 'message_listener', 'broker=kafka'||CASE WHEN p_size > 25 THEN '' ELSE ';topic=t.'||p_name END FROM timed WHERE slot = 'listener'
  UNION SELECT gv, entity, 'entity', 'fqcn='||fqcn FROM ents UNION SELECT gv, tab, 'table', 'tableName='||name FROM ents""", *ALLG)
define_rec("graph_diagnostics", """SELECT * FROM (SELECT gv, count(*) AS total_edges, count(*) FILTER (type = 'unresolved') AS unresolved_edges,
    round(count(*) FILTER (type = 'unresolved') / count(*), 6) AS unresolved_rate, round(count(*) FILTER (type = 'unresolved' AND reason <> 'external_type') / count(*), 6) AS non_external_unresolved_rate FROM g GROUP BY 1)
  JOIN (SELECT gv, count(*) FILTER (outcome = 'external') AS external_calls, count(*) FILTER (index_miss) AS index_misses, count(*) FILTER (reason = 'ambiguous_overload') AS ambiguous_overloads,
    count(DISTINCT dst) FILTER (reason = 'ambiguous_overload') AS ambiguous_targets FROM classed GROUP BY 1) USING (gv)
  JOIN (SELECT gv, sum(unresolved_params) AS unresolved_params, round(sum(unresolved_params) / sum(arity), 6) AS unresolved_param_rate FROM fns WHERE inside GROUP BY 1) USING (gv)""", *ALLG)
define_rec("ambiguous_targets", "SELECT DISTINCT gv, dst FROM classed WHERE reason = 'ambiguous_overload'", *ALLG)
define("graph_profile", """SELECT 'edge_type' AS section, type AS name, count(*) AS n FROM edges_base GROUP BY 2 UNION ALL SELECT 'surface_kind', kind, count(*) FROM surf_base GROUP BY 2
  UNION ALL SELECT 'unresolved_reason', reason, count(*) FROM edges_base WHERE type = 'unresolved' GROUP BY 2
  UNION ALL (SELECT 'sample_route', key, 1 FROM (SELECT DISTINCT key FROM surf_base WHERE kind = 'http_route' ORDER BY key LIMIT 6))""", LINES, EB, SB)


# --- events -----------------------------------------------------------------------------------------------------
def sha(t):
    return f"substr(sha256({t}), 1, 40)"


def deliveries():
    return f"""
d0 AS (SELECT 'd'||CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS id, event_id AS n, ts, user_id AS u, user_id % 20 AS repo,
  CASE event_type WHEN 'click' THEN 'push' WHEN 'view' THEN 'pull_request' WHEN 'signup' THEN 'installation' WHEN 'error' THEN 'installation_repositories' ELSE 'ping' END AS event FROM events),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS rn FROM d0) WHERE rn = 1),
ddd AS (SELECT *, {sha("'b'||repo||'-'||(n // 50)")} AS base, {sha("'h'||u||'-'||(n // 400)")} AS head FROM dd),
pushes AS (SELECT * FROM ddd WHERE event = 'push' AND n % 9 <> 0),
units AS (SELECT 'analyze:'||repo||':push-'||head AS unit_id, repo AS repo_id, 'push' AS "trigger", NULL::BIGINT AS pr_number, base AS base_sha, head AS head_sha, id AS delivery_id, ts FROM pushes WHERE n % 30 <> 0
  UNION ALL SELECT 'analyze:'||repo||':'||(n % 50)||'-'||head, repo, 'pull_request', n % 50, base, head, id, ts FROM ddd WHERE event = 'pull_request' AND n % 4 <> 2),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, base_sha, head_sha ORDER BY ts, delivery_id) AS rn, max(ts) OVER (PARTITION BY repo_id, base_sha, head_sha) AS last_ts FROM units) WHERE rn = 1)"""


DEL = deliveries()
DEDUPED = """SELECT id, event, CASE WHEN event = 'ping' THEN 'ignored' ELSE event END AS route, strftime(ts, '%Y-%m-%d %H:%M:%S') AS received_at FROM dd"""
define("dedupe_deliveries", DEDUPED, DEL)
define("stream_dedupe", DEDUPED.replace("AS received_at", "AS received_at, true AS processed"), DEL)
define("units", """SELECT 'index:'||repo||':'||head AS unit_id, repo AS repo_id, 'index' AS "trigger", NULL::BIGINT AS pr_number, NULL AS base_sha, head AS head_sha, id AS delivery_id FROM pushes
  UNION ALL SELECT unit_id, repo_id, "trigger", pr_number, base_sha, head_sha, delivery_id FROM units""", DEL)
define("stream_units", """SELECT unit_id, repo_id, "trigger", pr_number, base_sha, head_sha, delivery_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_received FROM firsts""", DEL)
define("supersede", """SELECT unit_id, repo_id, "trigger", pr_number, base_sha, head_sha, delivery_id,
  EXISTS (SELECT 1 FROM firsts o WHERE o.repo_id = f.repo_id AND o."trigger" = f."trigger" AND o.pr_number IS NOT DISTINCT FROM f.pr_number
    AND (o.last_ts, o.base_sha, o.head_sha) > (f.last_ts, f.base_sha, f.head_sha)) AS superseded FROM firsts f""", DEL)
VLOG = f"""
vlog AS (SELECT user_id % 20 AS repo_id, {sha("'b'||(user_id % 20)||'-'||(event_id // 50)")} AS sha, ts + to_minutes(event_id % 15) AS seen,
  CASE WHEN value < 10 THEN 'building' WHEN value < 14 THEN 'failed' WHEN value < 16 THEN 'superseded' ELSE 'ready' END AS status FROM events),
logs AS (SELECT repo_id, sha, min(seen) FILTER (status IN ('ready','superseded')) AS usable, arg_max(status, struct_pack(a := seen, s := status)) AS last_status FROM vlog GROUP BY 1, 2)"""
define("await_base_graph", f"""SELECT unit_id, f.repo_id, f.base_sha, head_sha, outcome, outcome = 'wait' AND coalesce(last_status = 'failed', true) AS request_index,
  CASE WHEN outcome = 'failed' THEN 'base commit '||f.base_sha||' was never indexed' END AS error FROM (
    SELECT f.*, l.last_status, CASE WHEN l.usable <= f.ts + to_minutes(10) AND l.usable <= TIMESTAMP '2024-01-30 23:20:00' THEN 'use'
      WHEN TIMESTAMP '2024-01-30 23:20:00' >= f.ts + to_minutes(10) THEN 'failed' ELSE 'wait' END AS outcome
    FROM firsts f LEFT JOIN logs l ON l.repo_id = f.repo_id AND l.sha = f.base_sha) f""", DEL, VLOG)
define("stream_supersede", """SELECT unit_id, repo_id, base_sha, head_sha, EXISTS (SELECT 1 FROM firsts o WHERE o.repo_id = f.repo_id AND o."trigger" = f."trigger" AND o.pr_number IS NOT DISTINCT FROM f.pr_number
    AND (o.last_ts, o.base_sha, o.head_sha) > (f.last_ts, f.base_sha, f.head_sha)) AS superseded FROM firsts f""", DEL)
define("stream_await_base", """SELECT unit_id, repo_id, base_sha, head_sha, outcome FROM (
  SELECT f.*, CASE WHEN l.usable <= f.ts + to_minutes(10) THEN 'use' WHEN f.ts + to_minutes(10) <= (
      SELECT date_trunc('milliseconds', least((SELECT max(ts) FROM firsts), (SELECT max(seen) FROM vlog WHERE status IN ('ready', 'superseded')))) - to_minutes(30)) THEN 'failed' END AS outcome
  FROM firsts f LEFT JOIN logs l ON l.repo_id = f.repo_id AND l.sha = f.base_sha) WHERE outcome IS NOT NULL""", DEL, VLOG)
INST = """
inst AS (SELECT u % 40 AS github_installation_id, arg_max('l'||(n % 6), struct_pack(t := ts, i := id)) AS login, arg_max(CASE WHEN n % 2 = 0 THEN 'all' ELSE 'selected' END, struct_pack(t := ts, i := id)) AS sel,
  min(ts) AS created FROM ddd WHERE event = 'installation' GROUP BY 1)"""
define("registry_upsert", """SELECT repo AS github_repo_id, arg_max(owner, struct_pack(t := ts, i := id)) AS owner, 'n'||repo AS name,
    coalesce(arg_max(branch, struct_pack(t := ts, i := id)) FILTER (event IN ('push','pull_request')), '') AS default_branch,
    arg_max(u % 40, struct_pack(t := ts, i := id)) AS github_installation_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, 'repo' AS what
  FROM (SELECT *, CASE WHEN event IN ('push','pull_request') THEN 'acme' ELSE 'acme'||(n % 3) END AS owner, CASE WHEN n > 5000 THEN 'main' ELSE 'master' END AS branch
    FROM ddd WHERE event IN ('push','pull_request') OR event IN ('installation','installation_repositories') AND n % 7 <> 0) GROUP BY repo
  UNION ALL SELECT NULL, login, 'Organization', sel, github_installation_id, strftime(created, '%Y-%m-%d %H:%M:%S'), 'installation' FROM inst""", DEL, INST)
define("link_installation", """SELECT id, CASE WHEN i.github_installation_id IS NOT NULL THEN 'i'||i.github_installation_id END AS installation_id
  FROM ddd LEFT JOIN inst i ON i.github_installation_id = u % 40 AND i.sel = 'all' WHERE event IN ('push','pull_request')""", DEL, INST)
define("analysis_status", """SELECT 'a'||user_id AS analysis_id, (['queued','cloning','parsing','traversing','explaining'])[CAST(arg_max(event_id, ts) % 5 AS INT) + 1] AS status,
  CAST(50 + floor((arg_max(event_id, ts) % 7) / 7 * 45 + 0.5) AS BIGINT) AS pct, arg_max(event_id, ts) AS seq FROM events GROUP BY user_id""")


# --- grounding and explanations -----------------------------------------------------------------------------------
LISTS = f"""
crank AS ({SQL['direct_callers'][SQL['direct_callers'].rindex('SELECT * FROM (SELECT k.root_id'):]}),
ent AS ({SQL['entrypoints'][SQL['entrypoints'].rindex('SELECT root_id, e.src AS key'):]}),
callees AS ({SQL['now_depends_on'][SQL['now_depends_on'].rindex('SELECT c.root_id, h.dst AS key'):]})"""
define("context_nested", """SELECT root_id, 'callers' AS part, position AS pos, key, position||':'||usage||':'||confidence AS detail FROM crank
  UNION ALL SELECT root_id, 'entrypoints', row_number() OVER (PARTITION BY root_id ORDER BY key, kind), key, kind||':'||min_hops FROM ent
  UNION ALL SELECT root_id, 'data', row_number() OVER (PARTITION BY root_id ORDER BY key, kind), key, access||':'||confidence FROM data
  UNION ALL SELECT root_id, 'callees', row_number() OVER (PARTITION BY root_id ORDER BY key, type, is_new, confidence, inferred), key, type||':'||confidence FROM callees""",
       *ALL_PARTS, LISTS)
SQL["canonical_objects"] = """SELECT p_partkey, json, sha256(json) AS hash FROM (SELECT p_partkey,
  '{"alpha":{"k":"'||p_type||'","n":'||p_size||'},"list":[{"x":'||p_size||',"y":'||p_partkey||'}],"none":null,"zeta":"'||p_name||'"}' AS json FROM part)"""
DISP = DISPLAY.format(k="key")
SYMS = f"""
keyed AS (SELECT root_id, function_key AS key FROM header UNION ALL SELECT root_id, key FROM crank UNION ALL SELECT root_id, key FROM ent
  UNION ALL SELECT root_id, key FROM data UNION ALL SELECT root_id, key FROM callees),
syms AS (SELECT DISTINCT root_id, symbol FROM (
  SELECT root_id, unnest(CASE WHEN key LIKE 'fn:%' THEN [regexp_extract(key, 'fn:([^#]+)#', 1), regexp_extract(key, '([^.#:]+)#', 1), regexp_extract(key, '#([^(]+)', 1), 'java.lang.Long', 'Long', {DISP}]
    WHEN key LIKE 'job:%' THEN [regexp_extract(key, 'job:([^#]+)#', 1), regexp_extract(key, '([^.#:]+)#', 1), 'run', key]
    WHEN key LIKE 'route:%' THEN [substr(key, 7), split_part(substr(key, 7), ' ', 1), split_part(key, ' ', 2)]
    WHEN key LIKE 'listener:%' THEN [substr(key, 10), 'kafka', split_part(key, ':', 3)]
    WHEN key LIKE 'entity:%' THEN [substr(key, 8), regexp_extract(key, '([^.]+)$', 1)] WHEN key LIKE 'table:%' THEN [substr(key, 7)] ELSE [] END) AS symbol FROM keyed
  UNION ALL SELECT root_id, unnest([owner, name, file_path, regexp_extract(file_path, '([^/]+)$', 1)]) FROM header
  UNION ALL SELECT root_id, unnest([file_path, regexp_extract(file_path, '([^/]+)$', 1)]) FROM crank)),
nums AS (SELECT DISTINCT root_id, CAST(n AS VARCHAR) AS number FROM (
  SELECT root_id, unnest([pr_number, 1, caller_total, max_depth, nodes_visited, ambiguous_edges_on_path, parse_errors]) AS n FROM header
  UNION ALL SELECT root_id, unnest([hops, line]) FROM crank UNION ALL SELECT root_id, min_hops FROM ent))"""
define("symbol_allowlist", "SELECT root_id, symbol FROM syms", *ALL_PARTS, LISTS, SYMS)
define("number_allowlist", "SELECT root_id, number FROM nums", *ALL_PARTS, LISTS, SYMS)

RX_FILE, RX_CALL = r"\b[\w/-]+\.java\b", r"\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+\([^()]*\)"
RX_ROUTE = r"\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/[^\s,;.)]*"
RX_DOTTED, RX_SNAKE = r"\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"


def tokens(source, keep):
    stages = [("file", "t0", RX_FILE), ("call", "t1", RX_CALL), ("route", "t2", RX_ROUTE), ("dotted", "t3", RX_DOTTED), ("snake", "t3", RX_SNAKE), ("number", "t0", r"\b[0-9]+\b")]
    found = " UNION ALL ".join(f"SELECT {keep}, '{n}' AS stage, unnest(regexp_extract_all({t}, '{rx}')) AS token, generate_subscripts(regexp_extract_all({t}, '{rx}'), 1) - 1 AS pos FROM blanked"
                               for n, t, rx in stages)
    return f"""
blanked AS (SELECT *, regexp_replace(t2, '{RX_ROUTE}', ' ', 'g') AS t3 FROM (SELECT *, regexp_replace(t1, '{RX_CALL}', ' ', 'g') AS t2 FROM (
  SELECT *, text AS t0, regexp_replace(text, '{RX_FILE}', ' ', 'g') AS t1 FROM {source}))),
cand AS ({found})"""


define("candidates", "SELECT text_id, stage, pos, token FROM cand",
       "\ntexts0 AS (SELECT 'd'||doc_id AS text_id, text FROM documents UNION ALL SELECT 'p'||page_id, html FROM pages)", tokens("texts0", "text_id"))
TEMPLATE = f"""
t_callers AS (SELECT root_id, string_agg(display_name||' at '||file_path||':'||line||CASE WHEN inferred OR confidence <> 'exact' THEN ' (inferred edge)' ELSE '' END||': '||usage||
    CASE WHEN signature_compatible THEN '' ELSE ' — signature-incompatible' END||'.', ' ' ORDER BY position) AS txt FROM crank GROUP BY 1),
t_ent AS (SELECT root_id, string_agg({DISP}||CASE WHEN via_inferred_edge THEN ' (via an inferred edge)' ELSE '' END, ', ' ORDER BY key) AS txt FROM ent GROUP BY 1),
t_data AS (SELECT root_id, string_agg(key||' ('||access||CASE WHEN via_inferred_edge THEN ', via an inferred edge' ELSE '' END||')', ', ' ORDER BY key) AS txt FROM data GROUP BY 1),
t_new AS (SELECT root_id, string_agg(display_name, ', ' ORDER BY key, type) AS txt FROM callees WHERE is_new GROUP BY 1),
template AS (SELECT h.root_id, h.change_kind, h.visibility_changed,
    concat_ws(' ', display_name||' was '||CASE change_kind WHEN 'signature_changed' THEN 'changed with a signature change' ELSE change_kind END||' in '||file_path||'.',
      CASE WHEN return_type_changed THEN 'Return type changed from `'||base_signature||'` to `'||head_signature||'`.' END, CASE WHEN visibility_changed THEN 'Visibility changed.' END) AS what_changed,
    concat_ws(' ', CASE WHEN caller_total = 0 THEN 'No direct callers were found in the graph.' ELSE caller_total||' direct caller(s) found'||CASE WHEN truncated THEN ' (list truncated below).' ELSE '.' END END,
      c.txt, 'Reachable entrypoints: '||e.txt||'.', 'Data touched: '||d.txt||'.') AS who_is_affected,
    coalesce(nullif(concat_ws(' ', 'New dependencies introduced: '||n.txt||'.', CASE WHEN unresolved_rate > 0.05 THEN 'A notable share of calls in the base graph are unresolved.' END,
      CASE WHEN ambiguous_edges_on_path > 0 THEN ambiguous_edges_on_path||' ambiguous edge(s) lie on the affected path — the true callee could not be narrowed to one candidate.' END,
      CASE WHEN parse_errors > 0 THEN parse_errors||' touched file(s) had parse errors.' END,
      CASE WHEN depth_cap_hit THEN 'The reverse traversal hit its depth cap — some further-removed effects may be missing.' END), ''), 'No further concerns from the graph.') AS what_to_check
  FROM header h LEFT JOIN t_callers c USING (root_id) LEFT JOIN t_ent e USING (root_id) LEFT JOIN t_data d USING (root_id) LEFT JOIN t_new n USING (root_id))"""
define("template_sections", "SELECT root_id, what_changed, who_is_affected, what_to_check FROM template", *ALL_PARTS, LISTS, TEMPLATE)


def bad(attempt):
    clean = "visibility_changed" + (" OR change_kind = 'removed'" if attempt == 2 else "")
    return f"""
planted AS (SELECT *, CASE WHEN {clean} THEN '' ELSE CASE change_kind WHEN 'added' THEN ' It now takes 987654 steps.' WHEN 'removed' THEN ' See com.acme.Fake.doStuff() for more.'
    WHEN 'modified' THEN ' Then POST /nope, and rows of shadow_ledger.' ELSE '' END END AS extra FROM template),
texts0 AS (SELECT root_id, 'what_changed' AS section, what_changed AS text FROM planted UNION ALL SELECT root_id, 'who_is_affected', who_is_affected||extra FROM planted
  UNION ALL SELECT root_id, 'what_to_check', what_to_check FROM planted),""" + tokens("texts0", "root_id, section") + """,
slist AS (SELECT root_id, list(symbol) AS l FROM syms GROUP BY 1), nlist AS (SELECT root_id, list(number) AS n FROM nums GROUP BY 1),
bad AS (SELECT root_id, section, stage, pos, token, CASE WHEN stage = 'number' THEN 'number' ELSE 'symbol' END AS kind FROM cand JOIN slist USING (root_id) JOIN nlist USING (root_id)
  WHERE NOT CASE stage WHEN 'number' THEN list_contains(n, token) WHEN 'route' THEN list_contains(l, split_part(token, ' ', 1)) AND list_contains(l, substr(token, instr(token, ' ') + 1))
    WHEN 'file' THEN list_contains(l, token) WHEN 'snake' THEN list_contains(l, token)
    ELSE list_contains(l, split_part(token, '(', 1)) OR len(list_filter(string_split(split_part(token, '(', 1), '.'), lambda x: NOT list_contains(l, x))) = 0 END)"""


define("violations", "SELECT root_id, section, stage, pos, token, kind FROM bad", *ALL_PARTS, LISTS, SYMS, TEMPLATE, bad(1))


def renamed(sql):
    for n in ("planted", "texts0", "blanked", "cand", "slist", "nlist", "bad"):
        sql = re.sub(rf"\b{n}\b", n + "_2", sql)
    return sql


PARTS = f"""
terms AS (SELECT root_id, string_agg(token, ', ' ORDER BY place, token) AS terms FROM (
  SELECT root_id, token, min(struct_pack(a := section, b := stage, c := pos)) AS place FROM bad GROUP BY 1, 2) GROUP BY 1),
parts AS (SELECT root_id, 0 AS part, 0 AS pos, '' AS k1, '' AS k2, concat_ws(chr(10)||chr(10), 'Explain the change.',
    'These terms are not in the context object and must not appear again: '||terms, 'prompt version: v1', 'Context object:'||chr(10)||'{{"schema_version":1,"repo":'||
    to_json({{'owner': owner, 'name': name, 'pr_number': pr_number}})||',"changed_method":'||to_json({{'key': function_key, 'display_name': display_name,
    'change_kind': change_kind, 'file_path': file_path, 'signature_diff': {{'base': base_signature, 'head': head_signature, 'return_type_changed': return_type_changed,
    'params_changed': false, 'throws_added': []::VARCHAR[], 'visibility_changed': visibility_changed}}, 'source_diff': source_diff}})||',"affected_by":{{"direct_callers":[') AS text
    FROM header LEFT JOIN terms USING (root_id)
  UNION ALL SELECT root_id, 1, position, '', '', CASE WHEN position = 1 THEN '' ELSE ',' END||to_json({{'position': position, 'key': key, 'display_name': display_name, 'hops': hops,
    'file_path': file_path, 'line': line, 'usage': usage, 'signature_compatible': signature_compatible, 'confidence': confidence, 'inferred': inferred}}) FROM crank
  UNION ALL SELECT root_id, 2, 0, '', '', '],"direct_caller_total":'||caller_total||',"direct_callers_truncated":'||truncated||',"reachable_surfaces":{{"entrypoints":[' FROM header
  UNION ALL SELECT root_id, 3, 0, key, kind, CASE WHEN row_number() OVER (PARTITION BY root_id ORDER BY key, kind) = 1 THEN '' ELSE ',' END||
    to_json({{'key': key, 'kind': kind, 'min_hops': min_hops, 'via_inferred_edge': via_inferred_edge}}) FROM ent
  UNION ALL SELECT root_id, 4, 0, '', '', '],"data":[' FROM header
  UNION ALL SELECT root_id, 5, 0, key, kind, CASE WHEN row_number() OVER (PARTITION BY root_id ORDER BY key, kind) = 1 THEN '' ELSE ',' END||
    to_json({{'key': key, 'kind': kind, 'access': access, 'via_inferred_edge': via_inferred_edge, 'confidence': confidence}}) FROM data
  UNION ALL SELECT root_id, 6, 0, '', '', ']}},"traversal":'||to_json({{'max_depth': max_depth, 'depth_cap_hit': depth_cap_hit, 'nodes_visited': nodes_visited}})||'}},"now_depends_on":{{"callees":['
    FROM header
  UNION ALL SELECT root_id, 7, 0, key, type, CASE WHEN row_number() OVER (PARTITION BY root_id ORDER BY key, type) = 1 THEN '' ELSE ',' END||
    to_json({{'key': key, 'type': type, 'display_name': display_name, 'is_new': is_new, 'confidence': confidence, 'inferred': inferred}}) FROM callees
  UNION ALL SELECT h.root_id, 8, 0, '', '', ']}},"change_history":{{"commits":[],"truncated_at_rename":false}},"quality":'||to_json({{'unresolved_rate': coalesce(r.unresolved_rate, 0::DOUBLE),
    'ambiguous_edges_on_path': h.ambiguous_edges_on_path, 'parse_errors_in_touched_files': h.parse_errors}})||'}}' FROM header h JOIN changes c USING (root_id) LEFT JOIN rates r USING (gv))"""
PROMPTS = (*ALL_PARTS, LISTS, SYMS, TEMPLATE, bad(1), PARTS)
define("prompt_rows", "SELECT root_id, string_agg(text, '' ORDER BY part, pos, k1, k2) AS prompt FROM parts GROUP BY 1", *PROMPTS)
define("prompt_chunks", """SELECT root_id, chunk, string_agg(text, '' ORDER BY part, pos, k1, k2) AS text FROM (
  SELECT *, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY root_id ORDER BY part, pos, k1, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 2000 AS chunk FROM parts)
  GROUP BY 1, 2""", *PROMPTS)


TRIES = """
tries AS (SELECT t.root_id, t.change_kind, v1 IS NULL AS c1, v2 IS NULL AS c2, coalesce(v2, 0) AS v2, what_changed, t.who_is_affected, what_to_check, p1.extra AS e1, p2.extra AS e2
  FROM template t JOIN (SELECT root_id, extra FROM planted) p1 USING (root_id) JOIN (SELECT root_id, extra FROM planted_2) p2 USING (root_id)
  LEFT JOIN (SELECT root_id, count(*) AS v1 FROM bad GROUP BY 1) USING (root_id) LEFT JOIN (SELECT root_id, count(*) AS v2 FROM bad_2 GROUP BY 1) USING (root_id)),
resolved AS (SELECT root_id, change_kind, CASE WHEN c1 THEN 1 ELSE 2 END AS attempts, NOT c1 AND NOT c2 AS degraded, c1 OR c2 AS passed, CASE WHEN c1 THEN 0 ELSE v2 END AS violations,
  CASE WHEN c1 OR c2 THEN length('{"what_changed":"","who_is_affected":"","what_to_check":""}') + length(what_changed) + length(who_is_affected) + length(what_to_check) + length(CASE WHEN c1 THEN e1 ELSE e2 END) ELSE 0 END AS raw_length,
  length(what_changed) AS tokens_in FROM tries)"""
ATT = (*ALL_PARTS, LISTS, SYMS, TEMPLATE, bad(1), renamed(bad(2)), TRIES)
define("resolve_attempts", "SELECT root_id, attempts, degraded, passed, violations, raw_length FROM resolved", *ATT)
define("explanation_metrics", """SELECT change_kind AS model, 'v1' AS prompt_version, count(*) AS explanations, sum(tokens_in) AS input_tokens, count(*) AS output_tokens, sum(violations) AS violations,
  round(avg(CASE WHEN attempts > 1 THEN 1.0 ELSE 0.0 END), 6) AS rejected_share, round(avg(CASE WHEN attempts > 1 AND NOT degraded THEN 1.0 ELSE 0.0 END), 6) AS repaired_share,
  round(avg(CASE WHEN degraded THEN 1.0 ELSE 0.0 END), 6) AS degraded_share FROM resolved GROUP BY 1""", *ATT)
define("save_explanations", """SELECT id, context_hash, model FROM (SELECT *, row_number() OVER (PARTITION BY context_hash, model ORDER BY late, at0, id) AS rn FROM (
  SELECT 'e'||doc_id AS id, sha256(text) AS context_hash, lang AS model, doc_id AS at0, 0 AS late FROM documents
  UNION ALL SELECT 'c-'||conv_id||'-'||turn, sha256(text), 'en', turn, 1 FROM conversations)) WHERE rn = 1""")
define("cache_probe", "SELECT conv_id, turn, EXISTS (SELECT 1 FROM documents d WHERE d.text = c.text AND d.lang = 'en') AS is_hit FROM conversations c")
define("parse_generated", """SELECT doc_id, CASE WHEN lang = 'en' THEN sha256(text) END AS what_changed, CASE WHEN lang = 'en' THEN CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END END AS input_tokens,
  CASE WHEN lang = 'en' THEN 0 END AS output_tokens, CASE WHEN lang = 'en' THEN NULL WHEN lang IN ('de', 'fr') THEN 'missing section' ELSE 'not valid JSON' END AS error FROM documents""")

# --- read queries ----------------------------------------------------------------------------------------------------
STORED = f"""
listed AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, {pk('l_partkey')}) - 1 AS position FROM (
  SELECT l_orderkey, l_partkey, min(l_linenumber) AS ln FROM lineitem GROUP BY 1, 2)),
stored AS (SELECT 'a'||o_orderkey AS analysis_id, o_custkey AS repo_id, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS pr_number,
  CASE o_orderstatus WHEN 'P' THEN 'superseded' WHEN 'F' THEN 'ready' ELSE 'queued' END AS status, o_orderdate, o_orderkey FROM orders)"""
define("analysis_detail", f"""SELECT analysis_id, position, CASE WHEN l_partkey IS NOT NULL THEN {pk('l_partkey')} END AS function_key, CASE WHEN l_partkey IS NOT NULL THEN 'modified' END AS change_kind,
  sha256(CAST(l_partkey AS VARCHAR)) AS context_hash, p_name AS what_changed, p_type = 'PROMO' AS degraded FROM stored LEFT JOIN listed ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5 WHERE status = 'ready'""", STORED)
define("latest_for_pull", """SELECT repo_id, pr_number, analysis_id, status FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY o_orderdate DESC, analysis_id DESC) AS rn
  FROM stored WHERE pr_number IS NOT NULL AND status <> 'superseded') WHERE rn = 1""", STORED)
define("node_lookups", """SELECT 'function' AS what, f.gv AS graph_version_id, f.function_key AS key, body_hash AS value FROM fv_base f SEMI JOIN changes c ON c.gv = f.gv AND c.function_key = f.function_key
  UNION ALL SELECT 'surface', s.gv, key, kind FROM surf_base s SEMI JOIN edges_base e ON e.gv = s.gv AND e.src = s.key AND e.type IN ('handles','triggers')""", LINES, EB, SB, CHANGES)

# --- snapshots and data quality ------------------------------------------------------------------------------------------
UNIQUE = f"""
raw_surf AS (SELECT repo_id||':base' AS gv, {NODE} AS key FROM li WHERE in_base AND is_lead AND o_orderpriority <> '5-LOW'
  UNION ALL SELECT repo_id||':base', 'entity:com.acme.S'||l_suppkey FROM li JOIN supplier ON l_suppkey = s_suppkey WHERE in_base AND is_lead AND l_returnflag <> 'N'
  UNION ALL SELECT repo_id||':base', 'table:nation_'||s_nationkey FROM li JOIN supplier ON l_suppkey = s_suppkey WHERE in_base AND is_lead AND l_returnflag <> 'N' AND s_acctbal > 0),
both_fv AS (SELECT repo_id, function_key FROM fv_base UNION ALL SELECT repo_id, function_key FROM fv_head),
uniques AS (SELECT 'edges' AS table_name, concat_ws('|', gv, src, dst, type) AS key FROM raw_base
  UNION ALL SELECT 'surfaces', concat_ws('|', gv, key) FROM raw_surf
  UNION ALL SELECT 'function_versions', concat_ws('|', repo_id||':base', function_key) FROM both_fv
  UNION ALL SELECT 'functions', concat_ws('|', repo_id, function_key) FROM both_fv
  UNION ALL SELECT 'graph_versions', concat_ws('|', repo_id, sha, 'branch') FROM vlog
  UNION ALL SELECT 'analyses', concat_ws('|', repo_id, base_sha, head_sha) FROM units
  UNION ALL SELECT 'repos', concat_ws('|', 'github', c_nationkey) FROM customer
  UNION ALL SELECT 'installations', CAST(user_id % 40 AS VARCHAR) FROM events
  UNION ALL SELECT 'explanations', concat_ws('|', sha256(text), 'v1', lang) FROM documents
  UNION ALL SELECT 'deliveries', id FROM d0)"""
define("unique_key_report", "SELECT table_name, key, count(*) AS n FROM uniques GROUP BY ALL HAVING count(*) > 1", LINES, EB, CHANGES, DEL, VLOG, UNIQUE)
define("dangling_edges", """SELECT gv AS graph_version_id, side, key, count(*) AS n FROM (SELECT gv, 'src' AS side, src AS key FROM edges_base UNION ALL SELECT gv, 'dst', dst FROM edges_base) e
  WHERE key NOT LIKE 'unresolved:%' AND NOT EXISTS (SELECT 1 FROM fv_base f WHERE f.gv = e.gv AND f.function_key = e.key) AND NOT EXISTS (SELECT 1 FROM surf_base s WHERE s.gv = e.gv AND s.key = e.key)
  GROUP BY 1, 2, 3""", LINES, EB, SB, CHANGES)
define("retention_plan", """SELECT 'v'||o_orderkey AS graph_version_id, 'c'||o_custkey AS repo_id, CASE WHEN coalesce(pins, 0) = 0 THEN 'delete' ELSE 'supersede' END AS action
  FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS pins FROM (SELECT l_orderkey, l_linenumber, sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 0 GROUP BY 1)
    ON l_orderkey = o_orderkey
  WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1) c WHERE c.k = o.o_orderkey)""")
define("version_status", """SELECT 'v'||l_orderkey AS graph_version_id, CASE WHEN l_linestatus = 'O' THEN 'building' ELSE 'ready' END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
define("identity_upsert", f"""SELECT repo_id, {pk('l_partkey')} AS key, 'P'||l_partkey AS class_name, (['find','get','save','delete','count','run'])[CAST(l_partkey % 6 AS INT) + 1] AS method_name,
  'java.lang.Long' AS param_types, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen FROM li WHERE in_base OR in_head GROUP BY repo_id, l_partkey""", LINES)
define("snapshot_publish_read", "SELECT repo_id, gv AS graph_version_id, function_key, body_hash, CAST(start_line AS BIGINT) AS start_line FROM fv_head", LINES, CHANGES)
define("ingest_parse_responses", """SELECT gv||'|'||file_path AS graph_version_id, repo_id||'-base' AS sha, function_key, body_hash, CAST(end_line AS BIGINT) AS end_line, 'external_type' AS edge_reason,
  file_path||':'||start_line AS call_sites, 1 AS functions, 1 AS edges, 0 AS surfaces, CASE WHEN end_line > 50 THEN 1 ELSE 0 END AS parse_errors, 0.5::DOUBLE AS unresolved_rate,
  CASE WHEN end_line > 50 THEN 'boom' END AS message FROM fv_base
  UNION ALL SELECT gv||'|'||key, NULL, key, kind, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, attrs FROM surf_base""", LINES, CHANGES, SB)
define("snapshot_as_of", """SELECT 0 AS step, gv AS graph_version_id, function_key, body_hash FROM fv_base UNION ALL SELECT 1, gv, function_key, body_hash FROM fv_head
  UNION ALL SELECT 2, gv, function_key, body_hash FROM fv_head UNION ALL SELECT 3, gv, function_key, body_hash FROM fv_head WHERE CAST(repo_id[2:] AS INT) % 3 <> 0
  UNION ALL SELECT 3, repo_id||':again', function_key, body_hash FROM fv_base WHERE CAST(repo_id[2:] AS INT) % 3 = 0""", LINES, CHANGES)
#: Documents of the four runs with their version and whether they can be read, and the status of every version at the end.
RUNS = """
docs AS (SELECT *, l_partkey % 50 = 7 AS broken, CAST(repo_id[2:] AS INT) AS repo FROM (
  SELECT gv, 'base' AS v, repo_id, l_partkey, file_path, function_key, body_hash, start_line, end_line FROM fv_base
  UNION ALL SELECT gv, 'head', repo_id, l_partkey, file_path, function_key, body_hash, start_line, end_line FROM fv_head
  UNION ALL SELECT repo_id||':again', 'again', repo_id, l_partkey, file_path, function_key, body_hash, start_line, end_line FROM fv_base WHERE CAST(repo_id[2:] AS INT) % 3 = 0
  UNION ALL SELECT repo_id||':old', 'old', repo_id, l_partkey, file_path, function_key, body_hash, start_line, end_line FROM fv_base WHERE CAST(repo_id[2:] AS INT) % 5 = 0)),
found AS (SELECT DISTINCT gv, v, repo_id, repo FROM docs WHERE NOT broken UNION SELECT DISTINCT gv, 'base', repo_id, CAST(repo_id[2:] AS INT) FROM surf_base
  UNION SELECT DISTINCT gv, 'head', repo_id, CAST(repo_id[2:] AS INT) FROM surf_head),
asked AS (SELECT 'r'||n_nationkey AS repo_id, n_nationkey AS repo, v, p, CASE v WHEN 'again' THEN 'head' ELSE v END AS sha FROM nation,
  (VALUES ('base', 1), ('head', 3), ('lost', 4), ('again', 3), ('old', 2)) x(v, p)
  WHERE (v <> 'lost' OR n_nationkey % 5 <> 0) AND (v <> 'again' OR n_nationkey % 3 = 0) AND (v <> 'old' OR n_nationkey % 5 = 0)),
known AS (SELECT a.*, a.repo_id||':'||a.v AS gv, f.gv IS NOT NULL AS ok FROM asked a LEFT JOIN found f ON f.gv = a.repo_id||':'||a.v),
side AS (SELECT repo_id, bool_or(v = 'head' AND ok) AS has_head, bool_or(v = 'again' AND ok) AS has_again, bool_or(v = 'old' AND ok) AS has_old FROM known GROUP BY 1),
ended AS (SELECT k.gv, k.repo_id, k.repo_id||'-'||k.sha AS sha, k.v, k.p, CASE
    WHEN v = 'lost' THEN CASE WHEN has_again OR has_old THEN 'deleted' ELSE 'failed' END
    WHEN NOT ok THEN 'failed' WHEN v = 'head' AND has_again THEN 'replaced' WHEN v IN ('head', 'again', 'old') THEN 'ready'
    WHEN v = 'base' AND NOT has_head AND NOT has_again AND NOT has_old THEN 'ready' WHEN v = 'base' AND k.repo % 2 = 0 THEN 'superseded' ELSE 'deleted' END AS status
  FROM known k JOIN side USING (repo_id))"""
CUR = """
cur AS (SELECT gv FROM ended WHERE status = 'ready' AND v <> 'old')"""
RUN_PARTS = (LINES, CHANGES, SB, surfaces("head"), RUNS, CUR)
define("index_run", """SELECT 'function' AS what, gv AS graph_version_id, function_key AS key, body_hash AS value FROM docs JOIN cur USING (gv) WHERE NOT broken
  UNION ALL SELECT 'edge', gv, function_key, 'unresolved external_type '||file_path||':'||start_line FROM docs JOIN cur USING (gv) WHERE NOT broken
  UNION ALL SELECT 'surface', gv, key, kind FROM surf_head JOIN cur USING (gv)""", *RUN_PARTS)
define("index_versions", """SELECT gv AS graph_version_id, repo_id, sha, status, CASE WHEN status = 'failed' THEN 'no readable document' END AS error, CAST(p AS BIGINT) AS position FROM ended""", *RUN_PARTS)
define("index_stats", """SELECT gv AS graph_version_id, sum(f) AS functions, sum(f) AS edges, sum(s) AS surfaces, sum(f) AS external_calls, sum(e) AS parse_errors,
  CASE WHEN sum(f) > 0 THEN 0.5::DOUBLE END AS unresolved_rate FROM (
  SELECT gv, 1 AS f, 0 AS s, CASE WHEN end_line > 50 THEN 1 ELSE 0 END AS e FROM docs WHERE NOT broken
  UNION ALL SELECT gv, 0, 1, 0 FROM surf_base UNION ALL SELECT gv, 0, 1, 0 FROM surf_head) GROUP BY 1""", *RUN_PARTS)
define("edge_layouts", """SELECT side, gv AS graph_version_id, function_key AS src, 'unresolved:x#y' AS dst, 1 AS sites FROM docs JOIN cur USING (gv), (VALUES ('src'), ('dst')) x(side) WHERE NOT broken""", *RUN_PARTS)
define("quarantined_documents", """SELECT gv||'|'||file_path AS request_id, CASE WHEN end_line > 50 THEN ',"message":"' ELSE ':1,"parseErr' END AS tail, 'not valid JSON' AS error FROM docs WHERE broken""", *RUN_PARTS)
define("retention_applied", """SELECT x.name, gv AS graph_version_id, count(*) AS n FROM (
  SELECT 'function_versions' AS name, gv FROM docs WHERE NOT broken UNION ALL SELECT unnest(['edges', 'edges_by_dst']), gv FROM docs WHERE NOT broken
  UNION ALL SELECT 'surfaces', gv FROM surf_base UNION ALL SELECT 'surfaces', gv FROM surf_head) x JOIN ended USING (gv) WHERE status IN ('ready', 'superseded') GROUP BY 1, 2""", *RUN_PARTS)
EXPORTED = """
lines AS (SELECT name, gv, line, row_number() OVER (PARTITION BY name, gv ORDER BY k1, k2, k3, line) - 1 AS line_no FROM (
  SELECT 'functions' AS name, gv, function_key AS k1, '' AS k2, '' AS k3, to_json({'annotations': []::VARCHAR[], 'body_hash': body_hash, 'end_line': end_line, 'file_path': file_path,
    'function_key': function_key, 'graph_version_id': gv, 'is_abstract': false, 'is_interface_method': false, 'modifiers': CASE WHEN others = '' THEN [vis] ELSE [vis, 'final'] END,
    'param_names': ['id'], 'repo_id': repo_id, 'return_type': return_type, 'sha': repo_id||'-base', 'start_line': start_line})::VARCHAR AS line FROM fv_base
  UNION ALL SELECT 'surfaces', gv, key, '', '', to_json({'attrs': map_from_entries(list_transform(string_split(attrs, ';'), lambda a: {'k': split_part(a, '=', 1), 'v': split_part(a, '=', 2)})),
    'graph_version_id': gv, 'key': key, 'kind': kind, 'repo_id': repo_id})::VARCHAR FROM surf_base
  UNION ALL SELECT 'edges', gv, src, dst, type, to_json({'call_sites': list_transform(string_split(call_sites, ';'), lambda s: {'file_path': split_part(s, ':', 1), 'line': CAST(split_part(s, ':', 2) AS INT)}),
    'confidence': confidence, 'dst': dst, 'graph_version_id': gv, 'inferred': inferred, 'reason': reason, 'repo_id': repo_id, 'src': src, 'type': type})::VARCHAR FROM edges_base)),
files AS (SELECT name, gv, line_no // 200 AS file, count(*) AS n, sha256(string_agg(sha256(line), '' ORDER BY line_no)) AS digest FROM lines GROUP BY 1, 2, 3),
""" + ",\n".join(f"fold{i} AS (SELECT name, gv, file // 8 AS file, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY file)) AS digest, {depth} AS depth FROM {of} GROUP BY 1, 2, 3)"
                 for i, of, depth in ((1, "files", 1), (2, "fold1", 2), (3, "fold2", 3), (4, "fold3", 4)))
define("canonical_export", """SELECT name, gv AS graph_version_id, file, n AS rows, digest FROM files UNION ALL
  SELECT name, gv, NULL, CAST(n AS BIGINT), digest FROM (SELECT *, min(depth) FILTER (whole) OVER (PARTITION BY name) AS d FROM (
    SELECT *, max(file) OVER (PARTITION BY name, depth) = 0 AS whole FROM (SELECT * FROM fold1 UNION ALL SELECT * FROM fold2 UNION ALL SELECT * FROM fold3 UNION ALL SELECT * FROM fold4)))
  WHERE depth = d""", LINES, EB, SB, fv("base"), EXPORTED)
SQL["source_scan"] = r"""SELECT repo_id, 'head' AS sha, root||'/h'||(page_id % 17)||'/p'||page_id||'.java' AS path, size, root,
  CASE WHEN root LIKE 'target%' THEN 'solver_only' ELSE 'extraction' END AS root_kind FROM (
  SELECT 'r'||(page_id % 5) AS repo_id, page_id, strlen(html) AS size, CASE page_id % 4 WHEN 0 THEN 'src/main/java' WHEN 1 THEN 'src/test/java'
    WHEN 2 THEN 'target/gen/src/main/java' ELSE 'mod/src/main/java' END AS root FROM pages WHERE page_id % 6 <> 5)"""
FILES = r"""
pf0 AS (SELECT 'r'||(page_id % 5) AS repo_id, 'head' AS sha, CASE page_id % 4 WHEN 0 THEN 'src/main/java' WHEN 1 THEN 'src/test/java' WHEN 2 THEN 'target/gen/src/main/java' ELSE 'mod/src/main/java' END AS root,
  page_id % 4 IN (0, 3) AS extraction, page_id % 6 <> 5 OR url LIKE '%.java' AS is_java,
  CASE page_id % 4 WHEN 0 THEN 'src/main/java/' WHEN 1 THEN 'src/test/java/' WHEN 2 THEN 'target/gen/src/main/java/' ELSE 'mod/src/main/java/' END||regexp_replace(url, '^https?://', '')||CASE WHEN page_id % 6 = 5 THEN '' ELSE '.java' END AS path FROM pages)"""
define("source_roots", "SELECT DISTINCT repo_id, sha, root, CASE WHEN root LIKE 'target%' THEN 'solver_only' ELSE 'extraction' END AS root_kind FROM pf0", FILES)
define("java_files_gate", """SELECT repo_id, path, count(*) OVER (PARTITION BY repo_id) AS files, count(*) OVER (PARTITION BY repo_id) > 5 AS over_limit
  FROM (SELECT DISTINCT repo_id, path FROM pf0 WHERE extraction AND is_java AND path LIKE '%.example.com%')""", FILES)

# --- scalars ----------------------------------------------------------------------------------------------------------------
KEYS = f"""
sk AS (SELECT {pk('p_partkey')} AS key FROM part UNION ALL SELECT 'fn:com.acme.'||replace(p_name, ' ', '.')||'$In#<init>(int,java.lang.String[],'||p_type||')' FROM part
  UNION ALL SELECT 'fn:a.B#c(int,,'||p_name||')' FROM part UNION ALL SELECT 'fn:'||s_name||'#x(' FROM supplier UNION ALL SELECT 'route:GET /o/'||o_orderkey FROM orders
  UNION ALL SELECT url FROM pages UNION ALL SELECT 'listener:kafka:'||n_name FROM nation UNION ALL SELECT ':'||c_name FROM customer UNION ALL SELECT text FROM documents),
parsed AS (SELECT *, m AND NOT list_contains(string_split(params, ','), '') OR m AND params = '' AS ok FROM (
  SELECT key, regexp_full_match(key, '(?s)fn:([^#]+)#([^(]+)\\((.*)\\)') AS m, regexp_extract(key, '(?s)^fn:([^#]+)#([^(]+)\\((.*)\\)$', 1) AS fqcn,
    regexp_extract(key, '(?s)^fn:([^#]+)#([^(]+)\\((.*)\\)$', 2) AS method, regexp_extract(key, '(?s)^fn:([^#]+)#([^(]+)\\((.*)\\)$', 3) AS params,
    CASE WHEN instr(key, ':') > 1 AND split_part(key, ':', 1) IN ('fn','route','job','listener','entity','table','unresolved') THEN split_part(key, ':', 1) END AS kind FROM sk))"""
define("keys_parse_display", """SELECT sha256(key) AS key_hash, kind, kind IS NOT NULL AS is_node, coalesce(kind = 'fn', false) AS is_function, CASE WHEN ok THEN fqcn END AS fqcn,
  CASE WHEN ok THEN regexp_extract(fqcn, '([^.]*)$', 1) END AS class_name, CASE WHEN ok THEN method END AS method_name, CASE WHEN ok THEN replace(params, ',', '|') END AS params,
  sha256(CASE WHEN ok THEN regexp_extract(fqcn, '([^.]*)$', 1)||'.'||method||'('||array_to_string(list_transform(CASE WHEN params = '' THEN [] ELSE string_split(params, ',') END,
    lambda t: regexp_replace(t, '^[^\\[]*\\.', '')), ', ')||')' ELSE key END) AS display_hash, CASE WHEN ok THEN 'fn:'||fqcn||'#'||method||'('||params||')' END AS again FROM parsed""", KEYS)
define("keys_build_and_hash", f"""SELECT p_partkey, 'route:GET /'||p_type AS route, 'listener:jms:'||p_name AS listener, 'entity:com.acme.'||replace(p_brand, '#', '') AS entity, 'table:'||p_type AS tab,
  'unresolved:'||p_name||'#run' AS lost, 'job:'||substr({pk('p_partkey')}, 4) AS job, 'index:'||p_type||':'||p_name AS index_unit,
  'analyze:'||p_type||':'||CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'push' END||'-'||p_name AS analyze_unit,
  -(('0x'||substr(sha256(p_type||'/'||p_name), 1, 8))::BIGINT & 2147483647) AS repo_number, substr(p_name, instr(p_name, ' ') + 1) AS repo_name,
  'sha256:'||sha256(CASE WHEN p_size > 3 THEN p_name ELSE '' END) AS print FROM part""")
define("path_verb_scalars", """SELECT p_partkey, '/'||p_type||'/'||replace(p_name, ' ', '/') AS joined, CASE WHEN p_size > 25 THEN '/'||p_name ELSE '/'||p_type END AS path,
  CASE WHEN p_size > 25 THEN 'PATCH' ELSE 'ANY' END AS verb, false AS has_get, CASE WHEN p_size > 25 THEN NULL ELSE '/'||p_type END AS member,
  'h_t_m_l'||array_to_string(list_transform(string_split(p_name, ' '), lambda w: '_'||w), ' ') AS snake, 'Map[]' AS erased, 'a/'||p_name AS relative FROM part""")
define("access_and_visibility", f"""SELECT p_partkey, CASE WHEN p_partkey % 6 IN (2, 3) THEN 'write' ELSE 'read' END AS walk_access,
  (['read','write','write','read','write','unknown'])[CAST(p_partkey % 6 AS INT) + 1] AS store_access, CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN 'protected' ELSE 'public' END AS vis,
  (['calls this method','implements this interface method','overrides this method','reaches this method via a "queries" edge'])[CAST(p_partkey % 4 AS INT) + 1] AS usage,
  {NAMES.format('greatest(CAST(p_partkey % 4 AS INT), CAST(p_size % 4 AS INT))')} AS weaker, p_size % 4 AS rank,
  CASE WHEN p_size > 40 THEN 'static' WHEN p_size > 20 THEN 'protected final' ELSE 'public static' END||' '||p_type||' '||(['find','get','save','delete','count','run'])[CAST(p_partkey % 6 AS INT) + 1]||'(Long arg0)' AS signature
  FROM part""")
