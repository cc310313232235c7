"""SQL of the registered queries, for another engine to check them with: common table expressions by name, and what asks for them."""

from __future__ import annotations

import re

L = 500_000


def _chrom(k: str) -> str:
    return f"CASE WHEN {k} = 0 THEN 'chrX' ELSE 'chr' || ({k}) END"


def _lowess(p: str, points: str) -> dict[str, str]:
    """Curves {p}_curve (sample, x, fit, n) of points (sample, id, x, y): three robust passes."""
    out = {
        f"{p}_n": f"SELECT sample, count(*) AS n, least(count(*), greatest(2, CAST(floor(0.1 * count(*) + 1e-10) AS BIGINT))) AS k FROM {points} GROUP BY sample",
        f"{p}_x": f"SELECT sample, x, count(*) AS c, avg(y) AS plain FROM {points} GROUP BY sample, x",
        f"{p}_d": f"SELECT a.sample, a.x, b.x AS x2, abs(b.x - a.x) AS d, sum(b.c) OVER (PARTITION BY a.sample, a.x ORDER BY abs(b.x - a.x) RANGE UNBOUNDED PRECEDING) AS cum FROM {p}_x a JOIN {p}_x b ON a.sample = b.sample",
        f"{p}_h": f"SELECT d.sample, d.x, min(d.d) AS h FROM {p}_d d JOIN {p}_n n ON d.sample = n.sample WHERE d.cum >= n.k GROUP BY d.sample, d.x",
        f"{p}_t": f"""SELECT d.sample, d.x, d.x2, CASE WHEN h.h = 0 THEN CASE WHEN d.d = 0 THEN 1.0 ELSE 0.0 END WHEN d.d / h.h <= 0.001 THEN 1.0 WHEN d.d / h.h > 0.999 THEN 0.0 ELSE power(1 - power(d.d / h.h, 3), 3) END AS t
                      FROM {p}_d d JOIN {p}_h h ON d.sample = h.sample AND d.x = h.x""",
    }
    for k in range(4):
        weights = f"SELECT sample, id, x, y, 1.0::DOUBLE AS delta FROM {points}" if k == 0 else f"""SELECT r.sample, r.id, r.x, r.y, CASE WHEN u >= 0.999 THEN 0.0 WHEN u <= 0.001 THEN 1.0 ELSE power(1 - u * u, 2) END AS delta
            FROM (SELECT a.*, CASE WHEN m.m6 > 0 THEN a.r / m.m6 WHEN a.r > 0 THEN 1.0 ELSE 0.0 END AS u FROM {p}_r{k - 1} a JOIN (SELECT sample, 6 * median(r) AS m6 FROM {p}_r{k - 1} GROUP BY sample) m ON a.sample = m.sample) r"""
        out |= {
            f"{p}_p{k}": weights,
            f"{p}_w{k}": f"SELECT sample, x, sum(delta) AS w, sum(delta * y) AS wy FROM {p}_p{k} GROUP BY sample, x",
            f"{p}_m{k}": f"SELECT t.sample, t.x, sum(t.t * w.w) AS s0, sum(t.t * w.w * w.x) AS s1 FROM {p}_t t JOIN {p}_w{k} w ON t.sample = w.sample AND t.x2 = w.x GROUP BY t.sample, t.x",
            f"{p}_f{k}": f"""SELECT t.sample, t.x, CASE WHEN any_value(m.s0) > 0 THEN sum(t.t * w.wy) / any_value(m.s0) + CASE WHEN sum(t.t * w.w * power(w.x - m.s1 / m.s0, 2)) / any_value(m.s0) > 1e-12
                THEN (t.x - any_value(m.s1 / m.s0)) * sum(t.t * w.wy * (w.x - m.s1 / m.s0)) / sum(t.t * w.w * power(w.x - m.s1 / m.s0, 2)) ELSE 0 END ELSE any_value(x.plain) END AS fit
                FROM {p}_t t JOIN {p}_w{k} w ON t.sample = w.sample AND t.x2 = w.x JOIN {p}_m{k} m ON t.sample = m.sample AND t.x = m.x JOIN {p}_x x ON t.sample = x.sample AND t.x = x.x GROUP BY t.sample, t.x""",
            f"{p}_r{k}": f"SELECT p.sample, p.id, p.x, p.y, abs(p.y - f.fit) AS r FROM {p}_p{k} p JOIN {p}_f{k} f ON p.sample = f.sample AND p.x = f.x",
        }
    out[f"{p}_curve"] = f"SELECT f.sample, f.x, f.fit, n.n FROM {p}_f3 f JOIN {p}_n n ON f.sample = n.sample"
    return out


def _interpolated(queries: str, curve: str, least: int) -> str:
    """queries (sample, window_id, gc_pct) with fit, from curves of at least so many points."""
    return f"""SELECT q.sample, q.window_id, CASE WHEN a.x IS NULL THEN b.fit WHEN b.x IS NULL OR a.x = b.x THEN a.fit ELSE a.fit + (q.gc_pct - a.x) / (b.x - a.x) * (b.fit - a.fit) END AS fit
      FROM (SELECT sample, window_id, gc_pct, (SELECT max(c.x) FROM {curve} c WHERE c.sample = q0.sample AND c.n >= {least} AND c.x <= q0.gc_pct) AS lo, (SELECT min(c.x) FROM {curve} c WHERE c.sample = q0.sample AND c.n >= {least} AND c.x >= q0.gc_pct) AS hi FROM {queries} q0) q
      LEFT JOIN {curve} a ON a.sample = q.sample AND a.x = q.lo LEFT JOIN {curve} b ON b.sample = q.sample AND b.x = q.hi"""


def _depth(windows: str, samples: str) -> str:
    return f"""SELECT s.sample, w.window_id, w.chrom, w.start, w."end", coalesce(c.bases, 0) / (w."end" - w.start)::DOUBLE AS depth
      FROM {windows} w CROSS JOIN (SELECT unnest({samples}) AS sample) s
      LEFT JOIN (SELECT b.sample, w.window_id, sum(least(b."end", w."end") - greatest(b.start, w.start)) AS bases FROM templates b JOIN {windows} w ON b.chrom = w.chrom AND b.start < w."end" AND w.start < b."end" GROUP BY ALL) c
      ON c.sample = s.sample AND c.window_id = w.window_id"""


_GC = "(3000 + (start * 31 + CASE WHEN chrom = 'chrX' THEN 0 ELSE CAST(substr(chrom, 4) AS BIGINT) END * 17) % 3067) / 10000.0::DOUBLE"
_AUTO = "NOT regexp_matches({}, '^(chrX|chrY|chrM|X|Y|MT)')"


def _merged(source: str, keys: str) -> str:
    return f"""SELECT {keys}, min(start) AS start, max("end") AS "end" FROM (
        SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT {keys}, start, "end", CASE WHEN start <= max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {source}))
      GROUP BY {keys}, island"""


_FLAGS = """CASE WHEN pon_median > 0 THEN sqrt(pon_variance) / pon_median ELSE 0.0 END AS pon_cv"""


def _track(source: str, extreme: str) -> str:
    return f"""SELECT *, flag_high_cv | flag_zero_wes | flag_extreme_scaling | flag_pon_variance AS mask_rejected,
        CASE WHEN (flag_high_cv | flag_zero_wes | flag_extreme_scaling | flag_pon_variance) = 0 THEN log2(greatest(depth_scaled_ratio, 1e-3)) END AS log2_ratio
      FROM (SELECT *, CAST(pon_cv > 0.30 AS INT) AS flag_high_cv, CAST(raw_wes_depth = 0 AS INT) AS flag_zero_wes, CAST({extreme} AS INT) AS flag_extreme_scaling, is_high_variance AS flag_pon_variance
            FROM (SELECT *, {_FLAGS} FROM {source}))"""


CTES: dict[str, str] = {
    "sets": "SELECT greatest(1, (count(*) + 99) // 100) AS g FROM supplier",
    "each": "SELECT unnest(range(0, g)) AS i FROM sets",
    "sizes": f"SELECT {_chrom('k')} AS chrom, {L}::BIGINT AS size FROM (SELECT unnest(range(0, 5 * g)) AS k FROM sets)",
    "access": f'SELECT {_chrom("(n_nationkey % 5 + 5 * i)")} AS chrom, (n_nationkey // 5)::BIGINT * 100000 + 500 AS start, ((n_nationkey // 5)::BIGINT + 1) * 100000 AS "end" FROM nation, each',
    "targets": f'SELECT {_chrom("(s_suppkey % 5 + 5 * ((s_suppkey // 100) % g))")} AS chrom, (s_suppkey * 7919) % ({L} - 400) AS start, (s_suppkey * 7919) % ({L} - 400) + 120 + (s_suppkey % 7) * 30 AS "end" FROM supplier, sets',
    "centromeres": f'SELECT {_chrom("(r_regionkey % 5 + 5 * i)")} AS chrom, 200000 + 1000 * r_regionkey::BIGINT AS start, 215000 + 1000 * r_regionkey::BIGINT AS "end" FROM region, each',
    "tiles": 'SELECT chrom, s AS start, least(s + 5000, "end") AS "end" FROM (SELECT chrom, "end", unnest(range(start, "end", 5000)) AS s FROM access)',
    "widened": 'SELECT t.chrom, greatest(start - 200, 0) AS start, least("end" + 200, size) AS "end" FROM targets t JOIN sizes s ON t.chrom = s.chrom',
    "masks": "SELECT * FROM widened UNION ALL SELECT * FROM centromeres",
    "merged": _merged("masks", "chrom"),
    "cuts": 'SELECT t.chrom, t.start AS ts, t."end" AS te, m.start AS ms, m."end" AS me FROM tiles t JOIN merged m ON t.chrom = m.chrom AND m.start < t."end" AND t.start < m."end"',
    "fragments": """SELECT chrom, s AS start, e AS "end" FROM (
        SELECT chrom, coalesce(lag(me) OVER (PARTITION BY chrom, ts, te ORDER BY ms), ts) AS s, ms AS e FROM cuts
        UNION ALL SELECT chrom, max(me), te FROM cuts GROUP BY chrom, ts, te
        UNION ALL SELECT chrom, start, "end" FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.chrom = t.chrom AND c.ts = t.start AND c.te = t."end")) WHERE e > s""",
    "kept": 'SELECT * FROM fragments WHERE "end" - start >= 2500',
    "windows": f"""SELECT chrom || ':' || start || '-' || "end" AS window_id, chrom, start, "end", {_GC} AS gc_pct FROM kept""",
    "padded": f"""SELECT chrom || ':' || start || '-' || "end" AS window_id, chrom, start, "end", {_GC} AS gc_pct FROM (SELECT chrom, greatest(start - 1000, 0) AS start, least("end" + 1000, {L}) AS "end" FROM targets)""",
    "reads": f"""SELECT 's' || (l_orderkey % 4) AS sample, CAST(l_orderkey AS VARCHAR) AS qname, flag, chrom, pos, mapq, cigar, pos + CAST(l_quantity AS BIGINT) AS "end",
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS ord
      FROM (SELECT *, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % ({L} - 100) AS pos, {_chrom("(l_suppkey % 5 + 5 * ((l_suppkey // 100) % g))")} AS chrom, CAST(l_partkey % 61 AS INT) AS mapq, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'M' AS cigar,
        CAST(CASE WHEN l_partkey % 13 = 0 THEN 1024 WHEN l_partkey % 17 = 0 THEN 256 WHEN l_partkey % 19 = 0 THEN 4 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 64 ELSE 0 END AS INT) AS flag FROM lineitem, sets)""",
    "usable": 'SELECT sample, qname, chrom, pos AS start, "end" FROM reads WHERE mapq >= 20 AND flag & 3844 = 0',
    "templates": _merged("usable", "sample, qname, chrom"),
    "depth": _depth("windows", "['s0', 's1', 's2', 's3']"),
    "matrix": f"SELECT d.*, w.gc_pct, CASE WHEN (SELECT bool_or({_AUTO.format('window_id')}) FROM windows) THEN {_AUTO.format('d.window_id')} ELSE true END AS is_auto FROM depth d JOIN windows w ON d.window_id = w.window_id WHERE d.sample <> 's3'",
    "norm": "SELECT m.*, CASE WHEN middle <> 0 THEN depth / middle ELSE depth END AS norm, CASE WHEN middle <> 0 THEN 'ok' ELSE 'skipped' END AS status FROM matrix m JOIN (SELECT sample, median(depth) AS middle FROM matrix WHERE is_auto GROUP BY sample) s ON m.sample = s.sample",
    "points": "SELECT sample, window_id AS id, gc_pct AS x, norm AS y FROM norm WHERE is_auto AND norm > 0 AND gc_pct IS NOT NULL AND status = 'ok'",
    **_lowess("n", "points"),
    "fitted": _interpolated("norm", "n_curve", 10),
    "corrected": "SELECT n.*, f.fit, CASE WHEN f.fit IS NULL THEN norm ELSE norm / greatest(f.fit, 1e-4) END AS corrected FROM norm n LEFT JOIN fitted f ON n.sample = f.sample AND n.window_id = f.window_id WHERE status = 'ok'",
    "centred": "SELECT c.*, corrected / nullif(middle, 0) AS centred FROM corrected c JOIN (SELECT sample, median(corrected) AS middle FROM corrected WHERE is_auto GROUP BY sample) s ON c.sample = s.sample",
    "wide": "SELECT window_id, max(centred) FILTER (sample = 's0') AS d1, max(centred) FILTER (sample = 's1') AS d2, max(centred) FILTER (sample = 's2') AS d3 FROM centred GROUP BY window_id",
    "offs": "SELECT window_id, m, (d1 - d2) / sqrt(2) AS u, (d1 + d2 - 2 * d3) / sqrt(6) AS v FROM (SELECT *, (d1 + d2 + d3) / 3 AS m FROM wide)",
    "angle": "SELECT atan2(2 * sum(u * v), sum(u * u) - sum(v * v)) / 2 AS theta FROM offs",
    "turned": "SELECT window_id, m, (v * cos(theta) - u * sin(theta)) AS r, -sin(theta) AS a, cos(theta) AS b FROM offs, angle",
    "denoised": """SELECT window_id, 's0' AS sample, m AS row_mean, m + r * (a / sqrt(2) + b / sqrt(6)) AS denoised FROM turned
        UNION ALL SELECT window_id, 's1', m, m + r * (-a / sqrt(2) + b / sqrt(6)) FROM turned UNION ALL SELECT window_id, 's2', m, m + r * (-2 * b / sqrt(6)) FROM turned""",
    "stats": "SELECT window_id, median(denoised) AS pon_median, CASE WHEN var_pop(denoised) >= 1e-18 THEN var_pop(denoised) ELSE 0.0 END AS pon_variance FROM denoised GROUP BY window_id",
    "panel": "SELECT w.*, pon_median, pon_variance, CAST(pon_variance > (SELECT quantile_cont(pon_variance, 0.99) FROM stats) AS INT) AS is_high_variance FROM windows w JOIN stats s ON w.window_id = s.window_id",
    "tumour": "SELECT d.sample, d.depth AS raw_wes_depth, p.*, d.depth / CASE WHEN pon_median <= 0 THEN 1e-4 ELSE pon_median END AS ratio FROM depth d JOIN panel p ON d.window_id = p.window_id WHERE d.sample = 's3'",
    "b_points": "SELECT sample, window_id AS id, gc_pct AS x, ratio AS y FROM tumour WHERE raw_wes_depth > 0 AND gc_pct IS NOT NULL",
    **_lowess("b", "b_points"),
    "b_fit": _interpolated("tumour", "b_curve", 50),
    "b_rows": "SELECT t.*, CASE WHEN f.fit IS NULL THEN ratio ELSE ratio / greatest(f.fit, 1e-4) END AS depth_scaled_ratio FROM tumour t JOIN b_fit f ON t.sample = f.sample AND t.window_id = f.window_id",
    "track_b": _track("b_rows", "pon_median < 0.01 OR depth_scaled_ratio > 1000"),
    "target_depth": "SELECT d.*, p.gc_pct FROM (" + _depth("padded", "['s3']") + ") d JOIN padded p ON d.window_id = p.window_id",
    "library": f"SELECT sample, median(depth) AS library FROM (SELECT *, {_AUTO.format('chrom')} OR NOT bool_or({_AUTO.format('chrom')}) OVER (PARTITION BY sample) AS is_auto FROM target_depth) WHERE is_auto GROUP BY sample HAVING median(depth) > 0",
    "a_points": "SELECT t.sample, t.window_id AS id, gc_pct AS x, depth / library AS y FROM target_depth t JOIN library l ON t.sample = l.sample WHERE depth > 0 AND gc_pct IS NOT NULL",
    **_lowess("a", "a_points"),
    "a_norm": "SELECT t.*, raw_wes_depth / library AS norm FROM tumour t JOIN library l ON t.sample = l.sample",
    "a_fit": _interpolated("a_norm", "a_curve", 50),
    "a_rows": "SELECT t.*, CASE WHEN f.fit IS NULL THEN norm ELSE norm / greatest(f.fit, 1e-4) END / CASE WHEN pon_median <= 0 THEN 1e-4 ELSE pon_median END AS depth_scaled_ratio FROM a_norm t JOIN a_fit f ON t.sample = f.sample AND t.window_id = f.window_id",
    "track_a": _track("a_rows", "depth_scaled_ratio > 20 OR depth_scaled_ratio < 0.05"),
    "scales": 'SELECT chrom, start, "end", least(greatest(CASE WHEN depth_scaled_ratio IS NULL OR depth_scaled_ratio <= 1 OR mask_rejected = 1 THEN 1.0 ELSE depth_scaled_ratio END, 1), 50) AS own_scale FROM track_b',
    "candidates": "SELECT * FROM reads WHERE flag & 2308 = 0",
    "looked": 'SELECT r.*, coalesce(min_by(s.own_scale, s.start), 1.0) AS own_scale FROM candidates r LEFT JOIN scales s ON r.chrom = s.chrom AND s.start <= r.pos AND r.pos < s."end" GROUP BY ALL',
    "paired": "SELECT *, CAST((n - 1) // 2 AS BIGINT) AS pair_no, CAST((n - 1) % 2 AS BIGINT) AS nth, n % 2 = 0 OR n < c AS complete FROM (SELECT *, row_number() OVER (PARTITION BY sample, qname ORDER BY ord) AS n, count(*) OVER (PARTITION BY sample, qname) AS c FROM looked)",
    "scaled": """SELECT *, CASE WHEN complete THEN avg(own_scale) OVER (PARTITION BY sample, qname, pair_no) ELSE 1.0 END AS scale,
        CASE WHEN bool_or(nth = 1 AND flag & 64 <> 0) OVER (PARTITION BY sample, qname, pair_no) THEN 2 - nth ELSE nth + 1 END AS mate FROM paired""",
    "copied": """SELECT *, greatest(1, CAST(floor(scale) AS INT) + CAST(CAST(('0x' || substr(md5(sample || ':' || qname || ':' || pair_no || ':42'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < scale - floor(scale) AS INT)) AS copies FROM scaled WHERE complete""",
    "drawn": """SELECT *, greatest(1, CAST(floor(scale) AS INT) + CAST(CAST(('0x' || substr(md5(sample || ':' || qname || ':' || min(ord) OVER (PARTITION BY sample, qname, pair_no) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < scale - floor(scale) AS INT)) AS copies FROM scaled WHERE complete""",
    "streamed": """SELECT 'passthrough' AS kind, sample, qname, flag, chrom, pos, ord, 0 AS copy, NULL::INT AS mate FROM reads WHERE flag & 2308 <> 0
        UNION ALL SELECT 'orphan', sample, qname, flag, chrom, pos, ord, 0, NULL FROM scaled WHERE NOT complete
        UNION ALL SELECT 'pair', sample, CASE WHEN copy = 0 THEN qname ELSE qname || ':upscale_' || copy END, flag & ~1024, chrom, pos, ord, CAST(copy AS INT), CAST(mate AS INT) FROM (SELECT *, unnest(range(copies)) AS copy FROM drawn)""",
    "output": """SELECT 'passthrough' AS kind, sample, qname, flag, chrom, pos, ord, 0 AS copy, NULL::INT AS mate FROM reads WHERE flag & 2308 <> 0
        UNION ALL SELECT 'orphan', sample, qname, flag, chrom, pos, ord, 0, NULL FROM scaled WHERE NOT complete
        UNION ALL SELECT 'pair', sample, CASE WHEN copy = 0 THEN qname ELSE qname || ':upscale_' || copy END, flag & ~1024, chrom, pos, ord, CAST(copy AS INT), CAST(mate AS INT) FROM (SELECT *, unnest(range(copies)) AS copy FROM copied)""",
}


def query(final: str) -> str:
    """final, behind the expressions that it needs."""
    needed: set[str] = set()
    todo = [final]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    parts = ", ".join(f"{name} AS MATERIALIZED ({text})" for name, text in CTES.items() if name in needed)
    return f"WITH {parts} {final}" if parts else final
