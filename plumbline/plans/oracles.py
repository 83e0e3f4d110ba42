"""DuckDB SQL with the same rows and column names as the queries."""

from plumbline.plans.queries import TAU

_CURVES = "c AS (SELECT user_id AS curve_id, ts, epoch_us(ts) AS us, value FROM events)"
_RESAMPLE = f"""{_CURVES},
b AS (SELECT curve_id, value,
        least(floor(coalesce((us - min(us) OVER w) / nullif((max(us) OVER w - min(us) OVER w)::DOUBLE, 0), 0) * 16), 15)::INT AS bucket
      FROM c WINDOW w AS (PARTITION BY curve_id)),
r AS (SELECT curve_id, bucket, round(avg(value), 6) AS value FROM b GROUP BY 1, 2)"""
_GRID = f"""{_CURVES},
d AS (SELECT curve_id, ts::DATE AS day, avg(value) AS v FROM c GROUP BY 1, 2),
g AS (SELECT curve_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY curve_id),
grid AS (SELECT g.curve_id, g.day, round(d.v, 6) AS value FROM g LEFT JOIN d ON g.curve_id = d.curve_id AND g.day = d.day)"""
_PRED = """p0 AS (SELECT event_id, user_id, event_type AS label, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prediction FROM events),
p AS (SELECT event_id AS row_id, c_nationkey AS fold, label, prediction FROM p0 JOIN customer ON user_id = c_custkey WHERE prediction IS NOT NULL)"""
_METRICS = """k AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
m AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support,
        (SELECT count(*) FROM p WHERE prediction = class) AS predicted,
        (SELECT count(*) FROM p WHERE label = class AND prediction = class) AS tp FROM k)"""
_SHAPES = """s AS (SELECT curve_id, bucket, CASE WHEN max(value) OVER w > min(value) OVER w
        THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.0 END AS value
      FROM r WINDOW w AS (PARTITION BY curve_id))"""
_FOLDS = """y AS (SELECT user_id AS curve_id, round(avg(value), 6) AS mean_value FROM events GROUP BY 1),
l AS (SELECT curve_id, mean_value, c_mktsegment AS class, ((dense_rank() OVER (ORDER BY c_nationkey) - 1) % 5)::INT AS fold FROM y JOIN customer ON curve_id = c_custkey),
f AS (SELECT DISTINCT fold FROM l)"""

ORACLES: dict[str, str] = {
    "curve_features": f"""WITH {_CURVES},
x AS (SELECT *, max(value) OVER (PARTITION BY curve_id) AS vm FROM c WHERE value IS NOT NULL),
a AS (SELECT curve_id, count(*) AS n, min(value) AS v_min, max(value) AS v_max, median(value) AS med,
        min(us) AS t0, max(us) AS t1, min(us) FILTER (WHERE value = vm) AS tp,
        CASE WHEN max(us) > min(us) THEN regr_slope(value, us / 3.6e9) END AS b FROM x GROUP BY curve_id)
SELECT curve_id, n, v_min, v_max, round(med, 6) AS v_median,
  round((tp - t0)::DOUBLE / nullif((t1 - t0)::DOUBLE, 0), 6) AS rel_peak, round(b, 6) AS slope_per_hour FROM a""",
    "curve_normalize": f"""WITH {_CURVES}
SELECT curve_id, ts, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled
FROM c WINDOW w AS (PARTITION BY curve_id)""",
    "curve_resample": f"WITH {_RESAMPLE} SELECT curve_id, bucket, value FROM r",
    "curve_daily_grid": f"WITH {_GRID} SELECT curve_id, day, value FROM grid",
    "curve_ffill": f"""WITH {_GRID}
SELECT curve_id, day, last_value(value IGNORE NULLS) OVER (PARTITION BY curve_id ORDER BY day
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM grid""",
    "rolling_rows": f"""WITH {_CURVES} SELECT curve_id, ts, value, round(avg(value) OVER
  (PARTITION BY curve_id ORDER BY ts, value ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM c""",
    "rolling_range": f"""WITH {_CURVES} SELECT curve_id, ts, value, round(avg(value) OVER
  (PARTITION BY curve_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 6) AS rolling FROM c""",
    "sessionize_gaps": f"""WITH {_CURVES},
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY curve_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END AS new FROM c),
s AS (SELECT *, sum(new) OVER (PARTITION BY curve_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM g)
SELECT curve_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""",
    "template_assign": f"""WITH {_RESAMPLE}, {_SHAPES},
t AS (SELECT 'rise' AS class, i::INT AS bucket, i / 15.0::DOUBLE AS value, true AS is_target FROM range(16) q(i)
  UNION ALL SELECT 'fall', i::INT, 1.0::DOUBLE - i / 15.0::DOUBLE, true FROM range(16) q(i)
  UNION ALL SELECT 'level', i::INT, 0.5::DOUBLE, false FROM range(16) q(i)),
d AS (SELECT curve_id, class, is_target, avg((s.value - t.value) * (s.value - t.value)) AS d FROM s JOIN t USING (bucket) GROUP BY 1, 2, 3),
m AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY d, class) AS k FROM d)
SELECT curve_id, CASE WHEN d > {TAU} THEN 'extra' ELSE class END AS class,
  CASE WHEN d > {TAU} THEN false ELSE is_target END AS is_target, round(d, 6) AS distance FROM m WHERE k = 1""",
    "nearest_centroid": """WITH l AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS b FROM embeddings),
c AS (SELECT label AS nearest, b, avg(x) AS c FROM l GROUP BY 1, 2),
d AS (SELECT vec_id, nearest, sum((x - c) * (x - c)) AS d FROM l JOIN c USING (b) GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS k FROM d)
SELECT vec_id, nearest, round(d, 4) AS distance FROM m WHERE k = 1""",
    "robust_trends": """WITH c AS (SELECT user_id AS curve_id, epoch_us(ts) AS us, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
p AS (SELECT a.curve_id, sign(b.v - a.v) AS s, (b.v - a.v) / ((b.us - a.us) / 3.6e9) AS slope FROM c a JOIN c b ON a.curve_id = b.curve_id AND a.us < b.us),
m AS (SELECT curve_id, sum(s)::BIGINT AS s, median(slope) AS slope FROM p GROUP BY 1),
e AS (SELECT curve_id, v, count(*)::DOUBLE AS k FROM c GROUP BY 1, 2),
n AS (SELECT curve_id, sum(k) AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM e GROUP BY 1)
SELECT n.curve_id, n::BIGINT AS n, coalesce(s, 0)::BIGINT AS s, round(coalesce((s - sign(s)) / nullif(sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18), 0), 0), 6) AS z, round(slope, 6) AS slope_per_hour
FROM n LEFT JOIN m ON m.curve_id = n.curve_id""",
    "shape_assign": f"""WITH {_RESAMPLE}, {_SHAPES},
t AS (SELECT 0 AS cluster, i::INT AS bucket, 1.0::DOUBLE - i / 15.0::DOUBLE AS value FROM range(16) q(i)
  UNION ALL SELECT 1, i::INT, 0.5::DOUBLE FROM range(16) q(i) UNION ALL SELECT 2, i::INT, i / 15.0::DOUBLE FROM range(16) q(i)),
tz AS (SELECT cluster, bucket, CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS z FROM t WINDOW w AS (PARTITION BY cluster)),
sz AS (SELECT curve_id, bucket, CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS z FROM s WINDOW w AS (PARTITION BY curve_id)),
n AS (SELECT curve_id, sqrt(sum(z * z)) AS l FROM sz GROUP BY 1), tn AS (SELECT cluster, sqrt(sum(z * z)) AS l FROM tz GROUP BY 1),
cc AS (SELECT curve_id, cluster, tz.bucket - sz.bucket AS shift, sum(sz.z * tz.z) AS v FROM sz, tz GROUP BY 1, 2, 3),
d AS (SELECT cc.curve_id, cc.cluster, 1 - coalesce(max(v) / nullif(any_value(n.l) * any_value(tn.l), 0), 0) AS d FROM cc JOIN n ON n.curve_id = cc.curve_id JOIN tn ON tn.cluster = cc.cluster GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY round(d, 9), cluster) AS k FROM d)
SELECT curve_id, cluster::INT AS cluster, round(d, 6) AS distance FROM k WHERE k = 1""",
    "strength_tier": """WITH m AS (SELECT user_id AS curve_id, round(avg(value), 6) AS mean_value FROM events GROUP BY 1),
t AS (SELECT *, ntile(3) OVER (ORDER BY mean_value, curve_id) AS k FROM m)
SELECT curve_id, mean_value, CASE k WHEN 1 THEN 'weak' WHEN 2 THEN 'medium' ELSE 'strong' END AS tier FROM t""",
    "strength_tier_by_fold": f"""WITH {_FOLDS},
t AS (SELECT f.fold, mean_value, ntile(3) OVER (PARTITION BY f.fold ORDER BY mean_value, curve_id) AS k FROM f JOIN l ON f.fold <> l.fold),
c AS (SELECT fold, min(mean_value) FILTER (WHERE k = 2) AS lo, min(mean_value) FILTER (WHERE k = 3) AS hi FROM t GROUP BY 1)
SELECT curve_id, mean_value, l.fold, CASE WHEN mean_value < lo THEN 'weak' WHEN mean_value < hi THEN 'medium' ELSE 'strong' END AS tier FROM l JOIN c ON l.fold = c.fold""",
    "template_assign_by_fold": f"""WITH {_RESAMPLE}, {_SHAPES}, {_FOLDS},
m AS (SELECT f.fold, class, bucket, avg(value) AS v FROM f JOIN l ON f.fold <> l.fold JOIN s ON s.curve_id = l.curve_id GROUP BY 1, 2, 3),
d AS (SELECT l.curve_id, l.fold, m.class, avg((s.value - v) * (s.value - v)) AS d FROM l JOIN s ON s.curve_id = l.curve_id JOIN m ON m.fold = l.fold AND m.bucket = s.bucket GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY d, class) AS k FROM d)
SELECT curve_id, fold, CASE WHEN d > {2 * TAU} THEN 'extra' ELSE class END AS class, round(d, 6) AS distance FROM k WHERE k = 1""",
    "factor_join": """WITH m AS (SELECT user_id AS curve_id, round(avg(value), 6) AS mean_value FROM events GROUP BY 1)
SELECT curve_id, mean_value, c_nationkey, c_acctbal, c_mktsegment FROM m LEFT JOIN customer ON curve_id = c_custkey""",
    "factor_coverage": """SELECT lang, count(*) AS n, count(quality) AS n_quality, count(toxic) AS n_toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""",
    "asof_factor": """WITH o AS (SELECT o_custkey AS user_id, o_orderdate AS ts, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)
SELECT e.event_id, e.user_id, e.ts, o.price AS asof_price FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.ts""",
    "group_folds": """SELECT c_custkey, c_nationkey, ((dense_rank() OVER (ORDER BY c_nationkey) - 1) % 5)::INT AS fold FROM customer""",
    "logo_majority": """WITH own AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2),
tot AS (SELECT c_mktsegment, sum(n) AS n FROM own GROUP BY 1), g AS (SELECT DISTINCT c_nationkey FROM customer),
r AS (SELECT g.c_nationkey, tot.c_mktsegment, (tot.n - coalesce(own.n, 0))::BIGINT AS n_rest FROM g CROSS JOIN tot
  LEFT JOIN own ON own.c_nationkey = g.c_nationkey AND own.c_mktsegment = tot.c_mktsegment),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n_rest DESC, c_mktsegment) AS k FROM r)
SELECT c_nationkey, c_mktsegment AS majority, n_rest FROM k WHERE k = 1""",
    "confusion": f"WITH {_PRED} SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2",
    "macro_f1": f"""WITH {_PRED}, {_METRICS}
SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif((support + predicted)::DOUBLE, 0), 0)), 6) AS macro_f1, count(*) AS n_classes FROM m""",
    "macro_f1_by_fold": f"""WITH {_PRED},
k AS (SELECT label AS class FROM p UNION SELECT prediction FROM p), f AS (SELECT DISTINCT fold FROM p),
m AS (SELECT f.fold, class, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE prediction = class) AS predicted,
        count(*) FILTER (WHERE label = class AND prediction = class) AS tp FROM f CROSS JOIN k JOIN p ON p.fold = f.fold GROUP BY 1, 2)
SELECT fold, round(avg(coalesce(2.0::DOUBLE * tp / nullif((support + predicted)::DOUBLE, 0), 0)), 6) AS macro_f1 FROM m GROUP BY fold""",
    "class_recall": f"""WITH {_PRED}, {_METRICS}
SELECT class, support::BIGINT AS support, round(tp::DOUBLE / support::DOUBLE, 6) AS recall FROM m WHERE support > 0""",
    "baseline_report": f"""WITH {_PRED}, {_METRICS},
own AS (SELECT fold, label, count(*) AS n FROM p GROUP BY 1, 2), tot AS (SELECT label, sum(n) AS n FROM own GROUP BY 1), g AS (SELECT DISTINCT fold FROM p),
r AS (SELECT g.fold, tot.label, tot.n - coalesce(own.n, 0) AS n_rest FROM g CROSS JOIN tot LEFT JOIN own ON own.fold = g.fold AND own.label = tot.label),
maj AS (SELECT fold, label AS majority FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n_rest DESC, label) AS k FROM r) WHERE k = 1),
b AS (SELECT p.label AS class, count(*) FILTER (WHERE p.label = majority) AS tp FROM p JOIN maj ON p.fold = maj.fold GROUP BY 1)
SELECT m.class, support::BIGINT AS support, round(coalesce(m.tp::DOUBLE / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(m.tp::DOUBLE / nullif(predicted, 0)::DOUBLE, 0), 6) AS "precision",
  round(coalesce(2.0::DOUBLE * m.tp / nullif((support + predicted)::DOUBLE, 0), 0), 6) AS f1,
  round(coalesce(b.tp::DOUBLE / nullif(support, 0)::DOUBLE, 0), 6) AS majority_recall FROM m LEFT JOIN b ON m.class = b.class""",
    "interval_join": """SELECT p.o_orderkey, s.o_orderkey AS after FROM orders p JOIN orders s
  ON p.o_custkey = s.o_custkey AND p.o_orderdate >= s.o_orderdate AND p.o_orderdate < s.o_orderdate + CASE WHEN s.o_orderkey % 7 = 0 THEN INTERVAL 700 DAY ELSE INTERVAL 20 DAY END""",
    "hot_key_scan": """WITH e AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)
SELECT event_id, round(sum(value) OVER w, 4) AS total, last_value(value IGNORE NULLS) OVER w AS known,
  round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "with_match": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "without_match": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
    "roll_up": """SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment, c_nationkey)::BIGINT AS level, count(*) AS n, round(sum(c_acctbal), 2) AS total
FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""",
    "cube": "SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment, c_nationkey)::BIGINT AS level, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "pivot_counts": """SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS "AUTOMOBILE", count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS "BUILDING",
  count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "MACHINERY" FROM customer GROUP BY 1""",
    "top_rows": """SELECT c_custkey, c_nationkey, c_acctbal, rank::INT AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3""",
    "documents_of_fields": "SELECT c_custkey, c_name, c_acctbal, c_nationkey, NULL::VARCHAR AS absent FROM customer",
    "string_functions": """SELECT c_custkey, upper(c_name) AS up, length(c_name)::INT AS n, substr(c_name, 1, 4) AS head, regexp_replace(c_name, '[0-9]+', '#', 'g') AS masked, reverse(c_name) AS backward FROM customer""",
    "set_operations": """WITH o AS (SELECT DISTINCT o_custkey::BIGINT AS id FROM orders), e AS (SELECT DISTINCT user_id::BIGINT AS id FROM events)
SELECT id, 'both' AS side FROM o SEMI JOIN e USING (id) UNION ALL SELECT id, 'orders' FROM o ANTI JOIN e USING (id) UNION ALL SELECT id, 'events' FROM e ANTI JOIN o USING (id)""",
    "linear_shapley": """WITH s AS (SELECT avg(c_nationkey::DOUBLE) AS mx, avg(c_acctbal) AS my, regr_slope(c_acctbal, c_nationkey::DOUBLE) AS b FROM customer)
SELECT c_custkey, round(b * (c_nationkey::DOUBLE - mx), 4) AS phi, round(my, 4) AS base, round(my + b * (c_nationkey::DOUBLE - mx), 4) AS prediction FROM customer, s""",
}
