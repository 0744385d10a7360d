"""SQL that gives the same rows as the registered queries, on the same Parquet tables (ANSI SQL with list functions)."""

from __future__ import annotations

from strandlake.functions.residues import CODES, LETTERS, PAIRS

#: The parameters of the registered alignment queries.
WINDOW, SPAN, THRESHOLD = 3, 3, 0.1

# --- the sequences derived from embeddings, step by step -----------------------------------------------------------

BASE = """
cnt AS (SELECT count(*) AS n FROM embeddings),
win AS (SELECT s AS run_index, vec_id - 25 * s AS pos, vec_id, label, CAST(embedding AS DOUBLE[]) AS e
  FROM (SELECT *, unnest([vec_id // 25 - 1, vec_id // 25]) AS s FROM embeddings) t, cnt WHERE s >= 0 AND s <= n // 25 - 2),
noisy AS (SELECT a.vec_id, list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: 0.8 * p[1] + 0.6 * p[2]) AS e
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 37) % (SELECT n FROM cnt)),
tres AS (SELECT run_index, pos, noisy.e AS vec FROM win JOIN noisy USING (vec_id)),
qres AS (SELECT run_index, pos, e AS vec FROM win WHERE run_index % 20 = 0),
idx AS (SELECT run_index, string_agg(substr('ACDEFGHIKL', CAST(label + 1 AS INT), 1), '' ORDER BY pos) AS sequence FROM win GROUP BY run_index)"""

CELLS = BASE + """,
cells AS MATERIALIZED (SELECT q.run_index AS queryid, t.run_index AS dbid, t.pos AS y, q.pos AS x, list_cosine_similarity(q.vec, t.vec) AS c FROM qres q, tres t)"""

SCORES = CELLS + """,
summed AS (SELECT *, sum(c) OVER (PARTITION BY queryid, dbid, y - x ORDER BY y) AS s FROM cells),
scored AS MATERIALIZED (SELECT queryid, dbid, y, x, c, s - least(0, min(s) OVER (PARTITION BY queryid, dbid, y - x ORDER BY y)) AS h FROM summed)"""

STARTS = SCORES + f""",
lens AS (SELECT q.run_index AS queryid, t.run_index AS dbid, q.n AS nq, t.n AS nt
  FROM (SELECT run_index, count(*) AS n FROM qres GROUP BY 1) q, (SELECT run_index, count(*) AS n FROM tres GROUP BY 1) t),
border AS (
  SELECT queryid, dbid, my, nq AS mx, my - {SPAN} AS b FROM (SELECT *, unnest(range({SPAN}, nt + 1)) AS my FROM lens) a
  UNION ALL
  SELECT queryid, dbid, nt AS my, mx, nt - {SPAN} + nq - mx AS b FROM (SELECT *, unnest(range({SPAN}, nq)) AS mx FROM lens) a),
valued AS (SELECT border.*, coalesce(h, 0) AS h FROM border LEFT JOIN scored s ON s.queryid = border.queryid AND s.dbid = border.dbid AND s.y = my - 1 AND s.x = mx - 1),
starts AS (SELECT queryid, dbid, b // 2 AS pathid, my, mx, h FROM (
  SELECT *, row_number() OVER (PARTITION BY queryid, dbid, b // 2 ORDER BY h DESC, b) AS r, count(*) OVER (PARTITION BY queryid, dbid, b // 2) AS n FROM valued) t WHERE r = 1 AND n = 2)"""

MATRIX = """,
hm AS MATERIALIZED (
  SELECT queryid, dbid, y + 1 AS my, x + 1 AS mx, h FROM scored
  UNION ALL SELECT queryid, dbid, 0, m, 0 FROM (SELECT queryid, dbid, unnest(range(0, nq + 1)) AS m FROM lens) t
  UNION ALL SELECT queryid, dbid, m, 0, 0 FROM (SELECT queryid, dbid, unnest(range(1, nt + 1)) AS m FROM lens) t)"""

WALK = """,
near AS MATERIALIZED (SELECT a.queryid, a.dbid, a.my, a.mx, u.h AS up, l.h AS lt, d.h AS dg FROM hm a
  JOIN hm u ON u.queryid = a.queryid AND u.dbid = a.dbid AND u.my = a.my - 1 AND u.mx = a.mx
  JOIN hm l ON l.queryid = a.queryid AND l.dbid = a.dbid AND l.my = a.my AND l.mx = a.mx - 1
  JOIN hm d ON d.queryid = a.queryid AND d.dbid = a.dbid AND d.my = a.my - 1 AND d.mx = a.mx - 1 WHERE a.my > 1 AND a.mx > 1),
walk AS (
  SELECT queryid, dbid, pathid, 0 AS i, my, mx, TRUE AS diagonal FROM starts
  UNION ALL
  SELECT queryid, dbid, pathid, i + 1,
    CASE WHEN go = 'd' OR go = 'u' THEN my - 1 ELSE my END, CASE WHEN go = 'd' OR go = 'l' THEN mx - 1 ELSE mx END, go = 'd'
  FROM (
    SELECT *, CASE WHEN dg >= up - p AND dg >= lt - p THEN 'd' WHEN up > lt THEN 'u' ELSE 'l' END AS go, greatest(dg, up - p, lt - p) AS best
    FROM (SELECT w.*, n.up, n.lt, n.dg, CASE WHEN w.diagonal THEN 0 ELSE 0.5 END AS p FROM walk w JOIN near n USING (queryid, dbid, my, mx)) a) b
  WHERE best >= 1e-3),
paths AS MATERIALIZED (
  SELECT w.queryid, w.dbid, w.pathid, max(i) OVER (PARTITION BY w.queryid, w.dbid, w.pathid) - i AS k, my - 1 AS y, mx - 1 AS x, c.c
  FROM walk w JOIN cells c ON c.queryid = w.queryid AND c.dbid = w.dbid AND c.y = my - 1 AND c.x = mx - 1)"""

PATHS = STARTS + MATRIX + WALK

#: Global alignment: anti-diagonals of the score matrix, one after the other, as lists by row; one path from the last corner.
GLOBAL = CELLS + """,
mats AS MATERIALIZED (SELECT queryid, dbid, list(r ORDER BY y) AS m, count(*) AS nt, max(len(r)) AS nq FROM (SELECT queryid, dbid, y, list(c ORDER BY x) AS r FROM cells GROUP BY 1, 2, 3) t GROUP BY 1, 2),
diag AS (
  SELECT queryid, dbid, CAST(0 AS BIGINT) AS d, list_transform(range(0, nt + 1), lambda i: CAST(0 AS DOUBLE)) AS cur, list_transform(range(0, nt + 1), lambda i: CAST(0 AS DOUBLE)) AS prev FROM mats
  UNION ALL
  SELECT s.queryid, s.dbid, s.d + 1, list_transform(range(0, nt + 1), lambda i: CASE WHEN i < 1 OR s.d + 1 - i < 1 OR s.d + 1 - i > nq THEN 0 ELSE greatest(0, s.prev[i] + m[i][s.d + 1 - i], s.cur[i] - 0.5, s.cur[i + 1] - 0.5) END), s.cur
  FROM diag s JOIN mats USING (queryid, dbid) WHERE s.d < nt + nq),
hm AS MATERIALIZED (SELECT t.queryid, t.dbid, i AS my, d - i AS mx, h FROM (SELECT queryid, dbid, d, unnest(cur) AS h, unnest(range(0, len(cur))) AS i FROM diag) t JOIN mats USING (queryid, dbid) WHERE d - i >= 0 AND d - i <= nq),
starts AS (SELECT queryid, dbid, 0 AS pathid, nt AS my, nq AS mx FROM mats)""" + WALK + f""",
flat AS MATERIALIZED (SELECT queryid, dbid, pathid, 0 AS spanid, 0 AS span_start, count(*) AS span_end, min(y) AS y1, min(x) AS x1, max(y) AS y2, max(x) AS x2, avg(c) AS score, count(*) AS len
  FROM paths GROUP BY queryid, dbid, pathid HAVING count(*) >= {SPAN} AND least(max(y) - min(y), max(x) - min(x)) > {SPAN})"""

MEANS = PATHS + f""",
pre AS (SELECT *, sum(c) OVER (PARTITION BY queryid, dbid, pathid ORDER BY k) AS p, count(*) OVER (PARTITION BY queryid, dbid, pathid) AS n FROM paths),
ends AS (SELECT *, least({WINDOW}, n) AS w, greatest(least({WINDOW}, n) - 1, least(k, n - {WINDOW} - 1)) AS e FROM pre),
means AS MATERIALIZED (SELECT a.queryid, a.dbid, a.pathid, a.k, a.y, a.x, a.c, a.n, CASE WHEN a.c > 0 THEN (u.p - coalesce(l.p, 0)) / a.w ELSE 0 END AS m
  FROM ends a JOIN pre u ON u.queryid = a.queryid AND u.dbid = a.dbid AND u.pathid = a.pathid AND u.k = a.e
  LEFT JOIN pre l ON l.queryid = a.queryid AND l.dbid = a.dbid AND l.pathid = a.pathid AND l.k = a.e - a.w)"""

RUNS = MEANS + f""",
marked AS (SELECT *, sum(CASE WHEN m < {THRESHOLD} THEN 1 ELSE 0 END) OVER (PARTITION BY queryid, dbid, pathid ORDER BY k) AS isl FROM means),
runs AS MATERIALIZED (SELECT queryid, dbid, pathid, isl, min(k) AS first, max(k) AS last, max(k) - min(k) + 1 AS size, max(k) = max(n) - 1 AS final
  FROM marked WHERE m >= {THRESHOLD} GROUP BY queryid, dbid, pathid, isl)"""

HITS = RUNS + f""",
found AS (SELECT *, row_number() OVER (PARTITION BY queryid, dbid, pathid ORDER BY first) - 1 AS spanid FROM runs WHERE size >= {SPAN} AND (size > {SPAN} OR NOT final)),
points AS (SELECT f.queryid, f.dbid, f.pathid, f.spanid, f.first, f.last, p.k, p.y, p.x, p.c FROM found f
  JOIN paths p ON p.queryid = f.queryid AND p.dbid = f.dbid AND p.pathid = f.pathid AND p.k >= f.first AND p.k < f.last - 1 WHERE f.last - f.first >= {SPAN}),
flat AS MATERIALIZED (SELECT queryid, dbid, pathid, spanid, first AS span_start, last AS span_end, min(y) AS y1, min(x) AS x1, max(y) AS y2, max(x) AS x2,
    avg(c) AS score, last - first AS len FROM points GROUP BY queryid, dbid, pathid, spanid, first, last HAVING least(max(y) - min(y), max(x) - min(x)) > {SPAN}),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queryid, dbid, pathid, len, round(score, 9) ORDER BY y1, x1) AS r2 FROM (
    SELECT *, row_number() OVER (PARTITION BY queryid, dbid, y1, x1 ORDER BY round(score, 9) DESC, len DESC, pathid, spanid) AS r FROM flat) a WHERE r = 1) b WHERE r2 = 1)"""

POOL_STEPS = """,
tpool AS (SELECT run_index, pos, list_transform(range(0, 4), lambda i: list_sum(vec[i * 16 + 1 : i * 16 + 16]) / 16) AS v FROM tres),
qpool AS (SELECT run_index, pos, list_transform(range(0, 4), lambda i: list_sum(vec[i * 16 + 1 : i * 16 + 16]) / 16) AS v FROM qres),
tf AS MATERIALIZED (SELECT run_index, fold, o, p.v FROM (SELECT run_index, unnest(range(0, 9)) AS fold FROM (SELECT DISTINCT run_index FROM tres) t) f CROSS JOIN (SELECT unnest(range(0, 10)) AS o) k JOIN tpool p USING (run_index) WHERE p.pos = fold * 5 + o),
qf AS MATERIALIZED (SELECT run_index, fold, o, p.v FROM (SELECT run_index, unnest(range(0, 9)) AS fold FROM (SELECT DISTINCT run_index FROM qres) t) f CROSS JOIN (SELECT unnest(range(0, 10)) AS o) k JOIN qpool p USING (run_index) WHERE p.pos = fold * 5 + o),
tn AS (SELECT run_index, fold, sqrt(sum(list_dot_product(v, v))) AS norm FROM tf GROUP BY 1, 2),
qn AS (SELECT run_index, fold, sqrt(sum(list_dot_product(v, v))) AS norm FROM qf GROUP BY 1, 2),
dots AS (SELECT q.run_index AS queryid, t.run_index AS dbid, q.fold AS qfold, t.fold AS tfold, sum(list_dot_product(q.v, t.v)) AS d FROM qf q JOIN tf t USING (o) GROUP BY 1, 2, 3, 4),
chunks AS MATERIALIZED (SELECT queryid, dbid, max(d / (qn.norm * tn.norm)) AS score FROM dots JOIN qn ON qn.run_index = queryid AND qn.fold = qfold JOIN tn ON tn.run_index = dbid AND tn.fold = tfold GROUP BY 1, 2)"""

POOLED = BASE + POOL_STEPS

KEPT = "kept AS (SELECT * FROM (SELECT *, quantile_cont(score, 0.7) OVER (PARTITION BY queryid) AS thr FROM chunks) t WHERE score >= thr)"

INDEX = "index_rows AS (SELECT DISTINCT ON (run_index) *, coalesce(seqlens, length(seq)) AS seqlen FROM seqindex ORDER BY run_index)"
CURRENT_SCORED = "(SELECT DISTINCT ON (hit_id, score) * FROM hits WHERE score IS NOT NULL AND NOT isnan(score))"
DRAWN = """drawn AS (SELECT hit_id, qid, score, qstart, qend FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC) AS n FROM hits WHERE qid IS NOT NULL AND (score IS NULL OR NOT isnan(score))) t WHERE n = 1)"""
KEYS = "queryid, dbid, pathid, spanid, span_start, span_end, y1, x1, y2, x2, round(score, 6) AS score, len"


#: A sequence opens a slice if the total up to it passes the next multiple; none passes more than one.
_MULTIPLES = INDEX + """,
        t AS (SELECT job_id, run_index, seqlen, row_number() OVER w - 1 AS spot, sum(seqlen) OVER w AS upto FROM index_rows WINDOW w AS (PARTITION BY job_id ORDER BY run_index)),
        p AS (SELECT *, greatest(CAST(ceil(upto / {budget}.0) AS BIGINT) - 1, 0) AS passed FROM t),
        opened AS (SELECT *, spot + least(1, min(passed - spot) OVER (PARTITION BY job_id ORDER BY spot)) AS opens FROM p)"""


def _with(steps: str, final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{steps.strip()}\n{final}"


def _output(steps: str, best: str, rounded: str) -> str:
    return _with(steps + """,
        drawn AS (
          SELECT p.queryid, p.dbid, p.pathid, p.spanid, b.score, q.sequence AS qs, t.sequence AS ts, p.k, p.y, p.x,
            CASE WHEN lag(p.x) OVER w IS DISTINCT FROM p.x THEN substr(q.sequence, p.x + 1, 1) ELSE '-' END AS qc,
            CASE WHEN lag(p.y) OVER w IS DISTINCT FROM p.y THEN substr(t.sequence, p.y + 1, 1) ELSE '-' END AS tc
          FROM """ + best + """ b JOIN points p USING (queryid, dbid, pathid, spanid) JOIN idx q ON q.run_index = p.queryid JOIN idx t ON t.run_index = p.dbid
          WHERE b.score >= 0.3 WINDOW w AS (PARTITION BY p.queryid, p.dbid, p.pathid, p.spanid ORDER BY p.k)),
        lines AS (
          SELECT queryid, dbid, """ + rounded + """(max(score), 3) AS score, string_agg(qc, '' ORDER BY k) AS qseq, string_agg(tc, '' ORDER BY k) AS tseq,
            string_agg(CASE WHEN qc = '-' OR tc = '-' THEN ' ' WHEN qc = tc THEN '|' WHEN contains('""" + PAIRS + """', qc || tc) THEN '+' ELSE '.' END, '' ORDER BY k) AS con,
            """ + rounded + """(avg(CASE WHEN qc = tc THEN 1.0 ELSE 0.0 END), 2) AS ident,
            """ + rounded + """(avg(CASE WHEN translate(qc, '""" + LETTERS + "', '" + CODES + "') = translate(tc, '" + LETTERS + "', '" + CODES + """') THEN 1.0 ELSE 0.0 END), 2) AS similarity,
            min(x) AS qstart, max(x) AS qend, min(y) AS tstart, max(y) AS tend, max(length(qs)) AS qlen, max(length(ts)) AS tlen
          FROM drawn GROUP BY queryid, dbid, pathid, spanid)""", """
        SELECT 'S' || lpad(CAST(queryid AS VARCHAR), 6, '0') AS qid, score, ident, similarity, 'S' || lpad(CAST(dbid AS VARCHAR), 6, '0') AS sid, qstart, qend, qseq, con, tseq,
          tstart, tend, tlen, qlen, qend - qstart + 1 AS match_len, 'from vector ' || CAST(dbid * 25 AS VARCHAR) AS sdesc FROM lines""", True)


SQL: dict[str, str] = {
    "residue_cosine": _with(CELLS, "SELECT queryid, dbid, y, x, round(c, 6) AS c FROM cells"),
    "signal_enhancement": _with(CELLS, """
        SELECT queryid, dbid, y, x, round(((c - avg(c) OVER col) / stddev_pop(c) OVER col + (c - avg(c) OVER rw) / stddev_pop(c) OVER rw) / 2, 5) AS c
        FROM cells WINDOW col AS (PARTITION BY queryid, dbid, x), rw AS (PARTITION BY queryid, dbid, y)"""),
    "global_znorm": _with(CELLS, "SELECT queryid, dbid, y, x, round((c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-3), 5) AS c FROM cells WINDOW w AS (PARTITION BY queryid, dbid)"),
    "score_matrix": _with(SCORES, "SELECT queryid, dbid, y, x, round(h, 5) AS h FROM scored"),
    "best_cell": _with(SCORES, """
        SELECT queryid, dbid, round(h, 5) AS max_h, y, x FROM (SELECT *, row_number() OVER (PARTITION BY queryid, dbid ORDER BY h DESC, y, x) AS r FROM scored) t WHERE r = 1"""),
    "best_diagonal": _with(CELLS, "SELECT queryid, dbid, round(max(s), 5) AS best FROM (SELECT queryid, dbid, sum(c) AS s FROM cells GROUP BY queryid, dbid, y - x) t GROUP BY 1, 2"),
    "border_starts": _with(STARTS, "SELECT queryid, dbid, pathid, my, mx, round(h, 5) AS h FROM starts"),
    "traceback_paths": _with(PATHS, "SELECT queryid, dbid, pathid, k, y, x, round(c, 6) AS c FROM paths", True),
    "path_mask": _with(PATHS, "SELECT DISTINCT queryid, dbid, y, x FROM paths", True),
    "moving_mean": _with(MEANS, "SELECT queryid, dbid, pathid, k, round(m, 6) AS m FROM means", True),
    "alignment_runs": _with(RUNS, "SELECT queryid, dbid, pathid, first, last, size, final FROM runs", True),
    "local_hits": _with(HITS, f"SELECT {KEYS} FROM flat", True),
    "filtered_hits": _with(HITS, f"SELECT {KEYS} FROM best", True),
    "overlap_share": _with(HITS + """,
        ranked AS (SELECT *, row_number() OVER (PARTITION BY queryid, dbid ORDER BY pathid, spanid) - 1 AS r FROM flat),
        cellsof AS (SELECT r.queryid, r.dbid, r.r, p.y, p.x, count(*) OVER (PARTITION BY r.queryid, r.dbid, r.r) AS n FROM ranked r
          JOIN points p ON p.queryid = r.queryid AND p.dbid = r.dbid AND p.pathid = r.pathid AND p.spanid = r.spanid)""", """
        SELECT a.queryid, a.dbid, a.r AS i, b.r AS j, round(count(*) / max(b.n), 6) AS share FROM cellsof a
        JOIN cellsof b ON a.queryid = b.queryid AND a.dbid = b.dbid AND a.y = b.y AND a.x = b.x AND a.r > b.r GROUP BY 1, 2, 3, 4""", True),
    "global_hits": _with(GLOBAL, f"SELECT {KEYS} FROM flat", True),
    "unique_hits": _with(HITS + """,
        ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queryid, dbid ORDER BY pathid, spanid) AS r FROM flat),
        cellsof AS (SELECT r.queryid, r.dbid, r.r, p.y, p.x, count(*) OVER (PARTITION BY r.queryid, r.dbid, r.r) AS n FROM ranked r
          JOIN points p ON p.queryid = r.queryid AND p.dbid = r.dbid AND p.pathid = r.pathid AND p.spanid = r.spanid),
        alike AS (SELECT a.queryid, a.dbid, a.r AS i, b.r AS j FROM cellsof a JOIN cellsof b ON a.queryid = b.queryid AND a.dbid = b.dbid AND a.y = b.y AND a.x = b.x AND a.r > b.r
          GROUP BY 1, 2, 3, 4 HAVING count(*) > 0.8 * max(b.n)),
        ordered AS MATERIALIZED (SELECT r.queryid, r.dbid, r.r, coalesce(list(j) FILTER (j IS NOT NULL), []) AS others FROM ranked r LEFT JOIN alike l ON l.queryid = r.queryid AND l.dbid = r.dbid AND l.i = r.r GROUP BY 1, 2, 3),
        greedy AS (
          SELECT queryid, dbid, r, [r] AS kept, TRUE AS stays FROM ordered WHERE r = 1
          UNION ALL
          SELECT o.queryid, o.dbid, o.r, CASE WHEN list_has_any(g.kept, o.others) THEN g.kept ELSE list_append(g.kept, o.r) END, NOT list_has_any(g.kept, o.others)
          FROM greedy g JOIN ordered o ON o.queryid = g.queryid AND o.dbid = g.dbid AND o.r = g.r + 1)""", f"SELECT {KEYS} FROM ranked JOIN greedy USING (queryid, dbid, r) WHERE stays", True),
    "search_output": _output(HITS, "best", "round"),
    "full_search": _output(HITS + POOL_STEPS + ",\n" + KEPT + ",\nscreened AS (SELECT best.* FROM best JOIN kept USING (queryid, dbid))", "screened", "round_even"),
    "streamed_search": _output(HITS + POOL_STEPS + ",\n" + KEPT + ",\nscreened AS (SELECT best.* FROM best JOIN kept USING (queryid, dbid))", "screened", "round_even"),
    "vector_alignments": _with(HITS, "SELECT queryid, dbid, pathid, spanid, span_start, span_end, round(score, 6) AS score, len FROM best", True),
    "missing_vectors": _with(BASE, "SELECT run_index, 'S' || lpad(CAST(run_index AS VARCHAR), 6, '0') AS id FROM idx WHERE run_index % 20 <> 0"),
    "html_alignments": """
        SELECT hit_id, loaded_at, '<table>' || array_to_string(list_transform([qseq, con, tseq], lambda r: '<tr><td>' || array_to_string(regexp_extract_all(r, '(?s).'), '</td><td>') || '</td></tr>'), '') || '</table>' AS html FROM hits""",
    "truth_overlap": _with(HITS + """,
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queryid, dbid ORDER BY round(score, 9) DESC, len DESC, pathid DESC, spanid DESC) AS r FROM flat) t WHERE r = 1),
        got AS (SELECT p.queryid, p.dbid, p.y, p.x, p.k - p.first AS k FROM top t JOIN points p USING (queryid, dbid, pathid, spanid)),
        truth AS (SELECT queryid, dbid, x, x + 25 * (queryid - dbid) AS y, x AS k FROM (SELECT queryid, dbid, unnest(range(0, 50)) AS x FROM lens WHERE abs(queryid - dbid) <= 1) t
          WHERE x + 25 * (queryid - dbid) BETWEEN 0 AND 49),
        sizes AS (SELECT * FROM (SELECT queryid, dbid, count(*) AS nt FROM truth GROUP BY 1, 2) a JOIN (SELECT queryid, dbid, count(*) AS nf FROM got GROUP BY 1, 2) b USING (queryid, dbid)),
        q AS (SELECT queryid, dbid, max(m) AS m FROM (SELECT g.queryid, g.dbid, count(*) AS m FROM got g JOIN truth t ON g.queryid = t.queryid AND g.dbid = t.dbid AND g.x = t.x GROUP BY g.queryid, g.dbid, g.k - t.k) a GROUP BY 1, 2),
        t2 AS (SELECT queryid, dbid, max(m) AS m FROM (SELECT g.queryid, g.dbid, count(*) AS m FROM got g JOIN truth t ON g.queryid = t.queryid AND g.dbid = t.dbid AND g.y = t.y GROUP BY g.queryid, g.dbid, g.k - t.k) a GROUP BY 1, 2)""", """
        SELECT queryid, dbid, round(coalesce(q.m, 0) / nt, 6) AS q_truth, round(coalesce(q.m, 0) / nf, 6) AS q_found, round(coalesce(t2.m, 0) / nt, 6) AS t_truth, round(coalesce(t2.m, 0) / nf, 6) AS t_found
        FROM sizes LEFT JOIN q USING (queryid, dbid) LEFT JOIN t2 USING (queryid, dbid)""", True),
    "scan_json": _with(POOLED + ",\n" + KEPT, """
        SELECT queryid, '{' || string_agg('"' || dbid || '":{"file":"db/' || dbid || '.emb","score":' || round(score, 3) || '}', ',' ORDER BY dbid) || '}' AS result FROM kept GROUP BY queryid"""),
    "pooled_vectors": _with(POOLED, "SELECT run_index, pos, round(v[1], 6) AS v0, round(v[2], 6) AS v1, round(v[3], 6) AS v2, round(v[4], 6) AS v3 FROM tpool"),
    "fold_norms": _with(POOLED, "SELECT run_index, fold, round(norm, 6) AS fnorm FROM tn"),
    "chunk_scores": _with(POOLED, "SELECT queryid, dbid, round(score, 6) AS score FROM chunks"),
    "chunk_quantile": _with(POOLED, "SELECT queryid, dbid, round(score, 6) AS score FROM (SELECT *, quantile_cont(score, 0.7) OVER (PARTITION BY queryid) AS thr FROM chunks) t WHERE score >= thr"),
    "symmetric_pairs": _with(POOLED, "SELECT queryid, dbid, round(score, 6) AS score FROM chunks WHERE dbid >= queryid"),
    "residue_sums": _with(BASE + """,
        sums AS (SELECT run_index, list_transform(range(0, 64), lambda i: list_sum(list_transform(vs, lambda v: v[i + 1]))) AS v, f FROM (SELECT run_index, list(vec) AS vs, arg_min(vec, pos) AS f FROM tres GROUP BY 1) t)""", """
        SELECT run_index, round(v[1], 6) AS s0, round(v[64], 6) AS s63, round(list_cosine_similarity(v, f), 6) AS c FROM sums"""),
    "quantile_thresholds": """
        SELECT qid AS queryid, round(quantile_cont(score, 0.9), 6) AS threshold FROM hits WHERE qid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY qid""",
    "whole_sequence_screen": _with(BASE + """,
        ts AS (SELECT run_index, list_transform(range(0, 64), lambda i: list_sum(list_transform(vs, lambda v: v[i + 1]))) AS v FROM (SELECT run_index, list(vec) AS vs FROM tres GROUP BY 1) t),
        qs AS (SELECT run_index, list_transform(range(0, 64), lambda i: list_sum(list_transform(vs, lambda v: v[i + 1]))) AS v FROM (SELECT run_index, list(vec) AS vs FROM qres GROUP BY 1) t),
        sims AS (SELECT q.run_index AS queryid, t.run_index AS dbid, list_cosine_similarity(q.v, t.v) AS score FROM qs q, ts t)""", """
        SELECT queryid, dbid, round(score, 6) AS score FROM (SELECT *, quantile_cont(score, 0.7) OVER (PARTITION BY queryid) AS thr FROM sims) t WHERE score >= thr"""),
    "hit_rates": f"""
        WITH pairs AS (SELECT hit_id, loaded_at, string_split(qseq, '') AS q, string_split(tseq, '') AS t,
          string_split(translate(qseq, '{LETTERS}', '{CODES}'), '') AS gq, string_split(translate(tseq, '{LETTERS}', '{CODES}'), '') AS gt FROM hits)
        SELECT hit_id, loaded_at,
          array_to_string(list_transform(list_zip(q, t), lambda p: CASE WHEN p[1] = '-' OR p[2] = '-' THEN ' ' WHEN p[1] = p[2] THEN '|' WHEN contains('{PAIRS}', p[1] || p[2]) THEN '+' ELSE '.' END), '') AS con,
          round(list_sum(list_transform(list_zip(q, t), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) / least(len(q), len(t)), 6) AS ident,
          round(list_sum(list_transform(list_zip(gq, gt), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) / least(len(q), len(t)), 6) AS similarity FROM pairs""",
    "mirrored_hits": """
        WITH h AS (SELECT qid, score, sid, qstart, qend, qseq, con, tseq, tstart, tend, tlen, qlen, match_len FROM hits WHERE score IS NULL OR NOT isnan(score))
        SELECT * REPLACE (round(score, 3) AS score) FROM h
        UNION ALL
        SELECT sid AS qid, round(score, 3) AS score, qid AS sid, tstart AS qstart, tend AS qend, tseq AS qseq, con, qseq AS tseq, qstart AS tstart, qend AS tend, qlen AS tlen, tlen AS qlen, match_len
        FROM h WHERE qid IS NOT NULL AND sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h o WHERE o.qid = h.sid AND o.sid = h.qid)""",
    "all_mirrored_hits": """
        SELECT hit_id, qid, round(score, 3) AS score, sid, qstart, qend, tstart, tend, tlen, qlen, match_len FROM hits
        UNION ALL
        SELECT hit_id, sid AS qid, round(score, 3) AS score, qid AS sid, tstart AS qstart, tend AS qend, qstart AS tstart, qend AS tend, qlen AS tlen, tlen AS qlen, match_len
        FROM hits h WHERE qid IS NOT NULL AND sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.qid = h.sid AND o.sid = h.qid)""",
    "score_cut": "SELECT hit_id, qid, sid, score FROM hits WHERE score >= 0.5 AND NOT isnan(score)",
    "top_hits": f"""
        SELECT row_number() OVER (ORDER BY score DESC, qid NULLS FIRST, sid NULLS FIRST, qstart, tstart, qseq, tseq) AS index, qid, sid, score FROM (
          SELECT * FROM {CURRENT_SCORED} t ORDER BY score DESC, qid NULLS FIRST, sid NULLS FIRST, qstart, tstart, qseq, tseq LIMIT 100) b""",
    "merged_chains": """
        WITH RECURSIVE ranked AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY sid ORDER BY qstart, tstart, qend, tend, qid NULLS FIRST, score, qseq, tseq) AS pos FROM hits
          WHERE score >= 0.3 AND NOT isnan(score) AND sid IS NOT NULL AND qstart IS NOT NULL AND tstart IS NOT NULL),
        walk AS (
          SELECT sid, pos, qstart AS aq, tstart AS ta, 1 AS chain FROM ranked WHERE pos = 1
          UNION ALL
          SELECT sid, pos, CASE WHEN goes THEN aq ELSE q END, CASE WHEN goes THEN ta ELSE t END, CASE WHEN goes THEN chain ELSE chain + 1 END FROM (
            SELECT r.sid, r.pos, w.aq, w.ta, w.chain, r.qstart AS q, r.tstart AS t,
              r.qstart >= w.aq AND r.tstart >= w.ta AND (greatest(r.qstart - w.aq, r.tstart - w.ta) = 0
                OR least(r.qstart - w.aq, r.tstart - w.ta) / greatest(r.qstart - w.aq, r.tstart - w.ta) >= 0.7) AS goes
            FROM walk w JOIN ranked r ON r.sid = w.sid AND r.pos = w.pos + 1) s),
        placed AS (SELECT r.*, w.chain FROM ranked r JOIN walk w USING (sid, pos))
        SELECT sid, arg_min_null(qid, pos) AS qid, round(avg(score), 6) AS score, round(avg(ident), 6) AS ident, round(avg(similarity), 6) AS similarity, arg_min(qstart, pos) AS qstart, arg_max(qend, pos) AS qend,
          string_agg(qseq, '~~~~~' ORDER BY pos) AS qseq, string_agg(con, '     ' ORDER BY pos) AS con, string_agg(tseq, '~~~~~' ORDER BY pos) AS tseq, arg_min(tstart, pos) AS tstart,
          arg_max(tend, pos) AS tend, arg_min_null(tlen, pos) AS tlen, arg_min_null(qlen, pos) AS qlen,
          CASE WHEN count(*) > 1 THEN arg_max(qend, pos) - arg_min(qstart, pos) + 1 ELSE max(match_len) END AS match_len, arg_min_null(sdesc, pos) AS sdesc, count(*) AS merged
        FROM placed GROUP BY sid, chain""",
    "class_fields": f"""
        WITH {INDEX},
        places AS (SELECT run_index, description AS d, instr(description, ', X: ') AS x, instr(description, ', H: ') AS h, instr(description, ', T: ') AS t,
          instr(description, ', H:') AS h0, instr(description, ', T:') AS t0, instr(description, ', F:') AS f0 FROM index_rows)
        SELECT run_index, CASE WHEN x > 0 AND h0 > x THEN substr(d, x + 2, h0 - x - 2) END AS X, CASE WHEN h > 0 AND t0 > h THEN substr(d, h + 2, t0 - h - 2) END AS H,
          CASE WHEN t > 0 AND f0 > t THEN substr(d, t + 2, f0 - t - 2) END AS T FROM places""",
    "colour_numbers": f"""
        WITH {INDEX},
        places AS (SELECT description AS d, instr(description, ', X: ') AS x, instr(description, ', T: ') AS t, instr(description, ', H:') AS h0, instr(description, ', F:') AS f0 FROM index_rows),
        g AS (SELECT DISTINCT substr(d, x + 2, h0 - x - 2) AS X, substr(d, t + 2, f0 - t - 2) AS T FROM places WHERE x > 0 AND h0 > x AND t > 0 AND f0 > t),
        c AS (SELECT X, row_number() OVER (ORDER BY X) - 1 AS colour FROM (SELECT DISTINCT X FROM g WHERE X <> 'X: NO_X_NAME') n)
        SELECT g.X, g.T, c.colour FROM g LEFT JOIN c ON c.X = g.X""",
    "plot_rows": f"WITH {DRAWN} SELECT hit_id, qid, len FROM (SELECT hit_id, qid, qend - qstart AS len, row_number() OVER (PARTITION BY qid ORDER BY hit_id) AS n FROM drawn WHERE score >= 0.4) t WHERE n <= 25",
    "all_plot_rows": f"WITH {DRAWN} SELECT hit_id, qid, qend - qstart AS len FROM drawn WHERE score >= 0.4",
    "plot_lanes": f"""
        WITH RECURSIVE {DRAWN},
        ranked AS MATERIALIZED (SELECT qid, hit_id, score, qstart, qend, row_number() OVER (PARTITION BY qid ORDER BY score DESC, hit_id) AS r,
          min(score) OVER (PARTITION BY qid) AS low, max(score) OVER (PARTITION BY qid) AS high FROM drawn WHERE score >= 0.4 AND qstart IS NOT NULL AND qend IS NOT NULL),
        lanes AS (
          SELECT qid, r, hit_id, [qend] AS ends, CAST(1 AS BIGINT) AS lane FROM ranked WHERE r = 1
          UNION ALL
          SELECT qid, r, hit_id, CASE WHEN free = 0 THEN list_append(ends, qend) ELSE list_transform(ends, lambda e, i: CASE WHEN i = free THEN qend ELSE e END) END, CASE WHEN free = 0 THEN len(ends) + 1 ELSE free END
          FROM (SELECT n.*, l.ends, coalesce(list_position(list_transform(l.ends, lambda e: e <= n.qstart), TRUE), 0) AS free FROM lanes l JOIN ranked n ON n.qid = l.qid AND n.r = l.r + 1) t)
        SELECT qid, hit_id, CAST(lane AS INT) AS lane, CASE WHEN high > low THEN round((score - low) / (high - low), 6) ELSE 0 END AS shade FROM lanes JOIN ranked USING (qid, hit_id, r)""",
    "hit_report": f"""
        WITH best AS (SELECT * FROM {CURRENT_SCORED} t ORDER BY score DESC, qid NULLS FIRST, sid NULLS FIRST, qstart, tstart, qseq, tseq LIMIT 100),
        n AS (SELECT *, row_number() OVER (ORDER BY score DESC, qid NULLS FIRST, sid NULLS FIRST, qstart, tstart, qseq, tseq) AS no, CAST(score AS VARCHAR) AS s,
          (qstart + 1) || '-' || (qend + 1) AS q, (tstart + 1) || '-' || (tend + 1) AS t FROM best),
        w AS (SELECT *, greatest(0, 10 - length(q)) AS qpad, greatest(0, 8 - length(t)) AS tpad, chr(10) AS nl FROM n)
        SELECT no AS index,
          lpad(CAST(no AS VARCHAR), 3, ' ') || ' ' || sid || repeat(' ', greatest(0, 27 - length(sid))) || ' ' || s || repeat(' ', greatest(0, 5 - length(s))) || ' '
            || repeat(' ', qpad // 2) || q || repeat(' ', qpad - qpad // 2) || ' ' || repeat(' ', tpad // 2) || t || repeat(' ', tpad - tpad // 2) || ' (' || tlen || ')' AS header,
          nl || nl || 'No ' || no || nl || '>' || coalesce(sdesc, 'nan') || nl || 'Score=' || s || ' Identities=' || CAST(round_even(ident * 100, 0) AS INT) || '% Similarity=' || CAST(round_even(similarity, 2) AS VARCHAR) || nl || nl
            || CASE WHEN contains(qseq, '~~~~~') THEN 'Warning: this is a merged match. The linking points are indicated with "~~~~~"' || nl || nl ELSE '' END
            || 'Q ' || lpad(CAST(qstart + 1 AS VARCHAR), 6, ' ') || ' ' || qseq || ' ' || rpad(CAST(qend + 1 AS VARCHAR), 6, ' ') || nl || '         ' || con || nl
            || 'T ' || lpad(CAST(tstart + 1 AS VARCHAR), 6, ' ') || ' ' || tseq || ' ' || rpad(CAST(tend + 1 AS VARCHAR), 6, ' ') AS body FROM w""",
    "prepared_sequences": f"WITH {INDEX} SELECT run_index, upper(substr(seq, 1, 1000)) AS seq, length(substr(seq, 1, 1000)) AS seqlen FROM index_rows WHERE seq IS NOT NULL",
    "length_statistics": f"""WITH {INDEX} SELECT count(*) AS sequences, min(least(length(seq), 1000)) AS shortest, round(avg(least(length(seq), 1000)), 6) AS mean_length, max(least(length(seq), 1000)) AS longest
        FROM index_rows WHERE seq IS NOT NULL""",
    "rank_shares": f"""WITH {INDEX}, t AS (SELECT greatest(1, (max(run_index) // 32 + 1) // 4) AS share FROM index_rows)
        SELECT run_index, run_index // 32 AS batch_id, least(run_index // 32 // share, 3) AS rank FROM index_rows, t""",
    "slice_batches": _with(_MULTIPLES.format(budget=7680), """
        SELECT job_id, min(run_index) AS first, max(run_index) AS last, count(*) AS sequences, CAST(sum(seqlen) AS BIGINT) AS residues FROM opened GROUP BY job_id, opens"""),
    "multiple_batches": _with(_MULTIPLES.format(budget=4000) + """,
        earlier AS (SELECT job_id, run_index, seqlen, spot, lead(opens, 1, opens) OVER (PARTITION BY job_id ORDER BY spot) AS opens FROM opened)""", """
        SELECT job_id, min(spot) // 50000 AS block, CAST(row_number() OVER (PARTITION BY job_id ORDER BY opens) - 1 AS INT) AS batch_no, min(run_index) AS first, max(run_index) AS last,
          CAST(count(*) AS INT) AS sequences, CAST(sum(seqlen) AS BIGINT) AS residues FROM earlier GROUP BY job_id, opens"""),
    "adaptive_batches": f"""WITH RECURSIVE {INDEX},
        t AS MATERIALIZED (SELECT job_id, run_index, seqlen, row_number() OVER w - 1 AS spot, sum(seqlen) OVER w AS upto, count(*) OVER (PARTITION BY job_id) AS n FROM index_rows WINDOW w AS (PARTITION BY job_id ORDER BY run_index)),
        fits AS (SELECT b.job_id, b.spot, b.n, b.seqlen AS one, (SELECT count(*) FROM t e WHERE e.job_id = b.job_id AND e.spot >= b.spot AND e.upto <= b.upto - b.seqlen + 6000) // 4 AS kept, (b.n - b.spot) // 4 AS whole, (b.n - b.spot) % 4 AS odd,
            coalesce((SELECT max(e.seqlen) FROM t e WHERE e.job_id = b.job_id AND e.spot = b.spot + 1), 0) AS two FROM t b),
        sizes AS MATERIALIZED (SELECT job_id, spot, n, CASE WHEN kept >= whole AND odd > 0 THEN CASE WHEN whole > 0 THEN 4 * whole ELSE odd END
            WHEN least(kept, whole - 1) > 0 THEN 4 * least(kept, whole - 1) WHEN one + two <= 6000 THEN 2 ELSE 1 END AS size,
            kept >= whole AND odd > 0 AS tail FROM fits),
        walk AS (
          SELECT job_id, spot, n, size, tail, 0 AS batch_no FROM sizes WHERE spot = 0
          UNION ALL
          SELECT s.job_id, s.spot, s.n, CASE WHEN w.tail THEN w.n - s.spot ELSE s.size END, s.tail OR w.tail, w.batch_no + 1 FROM walk w JOIN sizes s ON s.job_id = w.job_id AND s.spot = w.spot + w.size)
        SELECT w.job_id, w.spot // 50000 AS block, w.batch_no, min(t.run_index) AS first, max(t.run_index) AS last, CAST(w.size AS INT) AS sequences, CAST(sum(t.seqlen) AS BIGINT) AS residues
        FROM walk w JOIN t ON t.job_id = w.job_id AND t.spot >= w.spot AND t.spot < w.spot + w.size GROUP BY w.job_id, w.spot, w.batch_no, w.size""",
    "resume_points": """
        SELECT job_id, rank_id, last_batch FROM (SELECT *, row_number() OVER (PARTITION BY job_id, rank_id ORDER BY saved_at DESC, last_batch DESC NULLS LAST) AS n FROM emb_checkpoint WHERE job_id IS NOT NULL) t WHERE n = 1""",
    "resume_rows": f"""WITH {INDEX} SELECT run_index, job_id, seqlen FROM index_rows i
        WHERE NOT EXISTS (SELECT 1 FROM embfile e WHERE e.run_index = i.run_index AND ext = '.emb' AND size_bytes > 0 AND octet_length(payload) = size_bytes)""",
    "length_chunks": f"""WITH {INDEX}
        SELECT run_index, CAST((row_number() OVER (ORDER BY seqlen, run_index) - 1) // 100 + 1 AS VARCHAR) AS part FROM index_rows WHERE seqlen <= 800
        UNION ALL SELECT run_index, 'CPU' FROM index_rows WHERE seqlen > 800""",
    "unique_ids": f"""WITH {INDEX}, ok AS (SELECT count(*) = count(DISTINCT id) AS good FROM index_rows)
        SELECT run_index, CASE WHEN good THEN id ELSE CAST(run_index AS VARCHAR) END AS id FROM index_rows, ok""",
    "fasta_round_trip": f"WITH {INDEX} SELECT id, id AS description, upper(seq) AS sequence FROM index_rows WHERE id IS NOT NULL AND seq <> ''",
    "hits_csv_round_trip": "SELECT qid, sid, score, qstart, con, match_len FROM hits WHERE qid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)",
    "all_hits_csv_round_trip": "SELECT nullif(qid, '') AS qid, nullif(sid, '') AS sid, score, qstart, nullif(con, '') AS con, match_len, nullif(sdesc, '') AS sdesc FROM hits",
    "all_fasta_round_trip": f"""WITH {INDEX}, ok AS (SELECT count(*) = count(DISTINCT id) AS good FROM index_rows)
        SELECT CASE WHEN good THEN id ELSE CAST(run_index AS VARCHAR) END AS id, upper(seq) AS sequence FROM index_rows, ok WHERE seq <> ''""",
    "stream_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "p5_found": r"""
        WITH fields AS (
          SELECT 'seqindex' AS tab_name, run_index AS row_key, max(description) AS v FROM seqindex WHERE description <> '' AND description <> 'na' GROUP BY 2
          UNION ALL SELECT 'hits', hit_id, max(sdesc) FROM hits WHERE sdesc <> '' AND sdesc <> 'na' GROUP BY 2),
        parts AS (SELECT tab_name, row_key, regexp_extract_all(v, '(?s)(?: *"(?:[^"]|"")*"[^|;,\t"]*| *''(?:[^'']|'''')*''[^|;,\t'']*|(?:\\[|;,\t]|[^|;,\t])*)(?:[|;,\t]|$)') AS ps FROM fields WHERE row_key IS NOT NULL),
        flat AS (SELECT tab_name, row_key, unnest(ps) AS raw, unnest(range(1, len(ps) + 1)) AS pos FROM parts),
        read AS (SELECT tab_name, row_key, pos, CASE
            WHEN regexp_matches(raw, '(?s)^ *"(?:[^"]|"")*"') THEN replace(regexp_extract(raw, '(?s)^ *"((?:[^"]|"")*)"', 1), '""', '"')
            WHEN regexp_matches(raw, '(?s)^ *''(?:[^'']|'''')*''') THEN replace(regexp_extract(raw, '(?s)^ *''((?:[^'']|'''')*)''', 1), '''''', '''')
            ELSE trim(regexp_replace(regexp_extract(raw, '(?s)^((?:\\[|;,\t]|[^|;,\t])*)', 1), '\\([|;,\t])', '\1', 'g'), ' ') END AS piece FROM flat)
        SELECT tab_name, row_key, CAST(pos AS INT) AS pos, piece FROM read WHERE piece <> ''""",
    "p3_found": """
        WITH good AS (
          SELECT file_id, array_to_string(list_filter(string_split(embeddingpath, '/'), lambda s: s <> '' AND s <> '.'), '/') AS dir, run_index, modified_at
          FROM embfile WHERE ext = '.emb' AND size_bytes > 0 AND octet_length(payload) = size_bytes)
        SELECT file_id FROM (SELECT file_id, row_number() OVER (PARTITION BY dir, run_index ORDER BY modified_at DESC, file_id DESC) AS n FROM good) t WHERE n = 1""",
}
