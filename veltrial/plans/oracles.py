"""The same results in plain SQL, for an independent engine to check against."""

from __future__ import annotations

CTES = """
ods_event_log AS (
  SELECT CAST(ts AS DATE) AS ds, CAST(user_id AS VARCHAR) AS user_id, event_type AS event_name, CAST(value AS DOUBLE) AS metric_value FROM events),
ods_user_profile AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, DATE '2023-06-01' AS reg_ds,
    CASE WHEN user_id % 10 = 9 THEN NULL ELSE concat('c', CAST(user_id % 10 AS VARCHAR)) END AS city FROM events),
ods_exposure_log AS (
  SELECT CAST(ts AS DATE) AS ds, ts, CAST(user_id AS VARCHAR) AS user_id, 'exp_a' AS experiment,
    CASE WHEN (user_id * 7 + 3) % 11 < 5 THEN 'control' ELSE 'treatment' END AS variant, 'default' AS layer FROM events WHERE day(ts) >= 8 + user_id % 14
  UNION ALL
  SELECT CAST(ts AS DATE), ts, CAST(user_id AS VARCHAR), 'exp_city', CASE WHEN user_id % 10 % 2 = 0 THEN 'control' ELSE 'treatment' END, 'default'
  FROM events WHERE day(ts) >= 10 AND user_id % 10 < 9),
dim_experiment_config AS (
  SELECT e AS experiment, v AS variant, CAST(0.5 AS DOUBLE) AS design_weight, 'default' AS layer FROM (VALUES ('exp_a'), ('exp_city')) a(e), (VALUES ('control'), ('treatment')) b(v)),
dim_guardrail_config AS (SELECT 'exp_a' AS experiment, 'error' AS guardrail, 'lower_is_better' AS direction, CAST(0.05 AS DOUBLE) AS max_harm),
expo AS (SELECT experiment, variant, user_id, min(ts) AS expose_ts, CAST(min(ts) AS DATE) AS expose_ds FROM ods_exposure_log GROUP BY 1, 2, 3),
dwd AS (
  SELECT e.experiment, e.variant, e.user_id, e.expose_ds, e.expose_ts, p.city, p.reg_ds,
    coalesce(w.pre_metric, 0) AS pre_metric, coalesce(w.pre_cnt, 0) AS pre_cnt, coalesce(w.post_metric, 0) AS post_metric, coalesce(w.post_cnt, 0) AS post_cnt
  FROM expo e
  LEFT JOIN (SELECT x.experiment, x.variant, x.user_id,
      sum(CASE WHEN v.ds < x.expose_ds THEN v.metric_value ELSE 0 END) AS pre_metric, sum(CASE WHEN v.ds < x.expose_ds THEN 1 ELSE 0 END) AS pre_cnt,
      sum(CASE WHEN v.ds >= x.expose_ds THEN v.metric_value ELSE 0 END) AS post_metric, sum(CASE WHEN v.ds >= x.expose_ds THEN 1 ELSE 0 END) AS post_cnt
    FROM expo x JOIN ods_event_log v ON v.user_id = x.user_id AND v.event_name = 'purchase' AND v.ds >= x.expose_ds - INTERVAL 7 DAY AND v.ds < x.expose_ds + INTERVAL 7 DAY
    GROUP BY 1, 2, 3) w ON w.experiment = e.experiment AND w.variant = e.variant AND w.user_id = e.user_id
  LEFT JOIN ods_user_profile p ON p.user_id = e.user_id),
dws AS (
  SELECT experiment, variant, expose_ds AS ds, count(DISTINCT user_id) AS user_cnt, sum(post_metric) AS post_sum, sum(post_metric * post_metric) AS post_sq_sum, sum(pre_metric) AS pre_sum,
    sum(pre_metric * pre_metric) AS pre_sq_sum, sum(pre_metric * post_metric) AS pre_post_cross_sum, sum(post_cnt) AS post_event_cnt, sum(pre_cnt) AS pre_event_cnt FROM dwd GROUP BY 1, 2, 3),
ads AS (
  SELECT a.*, c.design_weight, c.layer, post_sum / user_cnt AS post_mean, pre_sum / user_cnt AS pre_mean,
    CASE WHEN user_cnt > 1 THEN (post_sq_sum - post_sum * post_sum / user_cnt) / (user_cnt - 1) END AS post_var,
    CASE WHEN user_cnt > 1 THEN (pre_sq_sum - pre_sum * pre_sum / user_cnt) / (user_cnt - 1) END AS pre_var,
    CASE WHEN user_cnt > 1 THEN (pre_post_cross_sum - pre_sum * post_sum / user_cnt) / (user_cnt - 1) END AS pre_post_cov
  FROM (SELECT experiment, variant, CAST(sum(user_cnt) AS BIGINT) AS user_cnt, sum(post_sum) AS post_sum, sum(post_sq_sum) AS post_sq_sum, sum(pre_sum) AS pre_sum, sum(pre_sq_sum) AS pre_sq_sum, sum(pre_post_cross_sum) AS pre_post_cross_sum
        FROM dws GROUP BY 1, 2) a LEFT JOIN dim_experiment_config c USING (experiment, variant)),
srm0 AS (SELECT experiment, variant, user_cnt, sum(user_cnt) OVER w * design_weight / nullif(sum(design_weight) OVER w, 0) AS expected_cnt FROM ads WINDOW w AS (PARTITION BY experiment)),
cluster_daily AS (
  SELECT experiment, variant, coalesce(city, 'UNKNOWN') AS cluster_id, expose_ds AS ds, count(DISTINCT user_id) AS user_cnt, sum(post_metric) AS post_sum, sum(post_metric * post_metric) AS post_sq_sum, sum(pre_metric) AS pre_sum,
    sum(pre_metric * pre_metric) AS pre_sq_sum, sum(pre_metric * post_metric) AS pre_post_cross_sum, sum(post_cnt) AS post_event_cnt, sum(pre_cnt) AS pre_event_cnt FROM dwd GROUP BY 1, 2, 3, 4),
ratio_daily AS (
  SELECT experiment, variant, expose_ds AS ds, count(DISTINCT user_id) AS user_cnt, sum(post_metric) AS sum_y, sum(post_cnt) AS sum_x, sum(post_metric * post_metric) AS sum_yy, sum(post_cnt * post_cnt) AS sum_xx, sum(post_metric * post_cnt) AS sum_xy
  FROM dwd GROUP BY 1, 2, 3),
ratio AS (SELECT experiment, variant, sum(user_cnt) AS n, sum(sum_y) AS y, sum(sum_x) AS x, sum(sum_yy) AS yy, sum(sum_xx) AS xx, sum(sum_xy) AS xy FROM ratio_daily GROUP BY 1, 2),
guard_daily AS (
  SELECT x.experiment, x.variant, v.ds, v.event_name AS guardrail, count(DISTINCT v.user_id) AS user_cnt, sum(v.metric_value) AS value_sum, sum(v.metric_value * v.metric_value) AS value_sq_sum
  FROM expo x JOIN ods_event_log v ON v.user_id = x.user_id AND v.ds >= x.expose_ds AND v.ds < x.expose_ds + INTERVAL 7 DAY
  JOIN dim_guardrail_config g ON g.experiment = x.experiment AND g.guardrail = v.event_name GROUP BY 1, 2, 3, 4),
guard AS (SELECT experiment, guardrail, variant, CAST(sum(user_cnt) AS BIGINT) AS n, sum(value_sum) AS y, sum(value_sq_sum) AS yy FROM guard_daily GROUP BY 1, 2, 3),
cov_daily AS (
  SELECT experiment, variant, expose_ds AS ds, count(DISTINCT user_id) AS user_cnt, sum(pre_metric) AS pre_metric_sum, sum(pre_metric * pre_metric) AS pre_metric_sq_sum, sum(pre_cnt) AS pre_cnt_sum, sum(pre_cnt * pre_cnt) AS pre_cnt_sq_sum,
    sum(pre_metric * pre_cnt) AS pre_metric_pre_cnt_cross_sum, sum(pre_metric * post_metric) AS pre_metric_post_cross_sum, sum(pre_cnt * post_metric) AS pre_cnt_post_cross_sum, sum(post_metric) AS post_metric_sum, sum(post_metric * post_metric) AS post_metric_sq_sum
  FROM dwd GROUP BY 1, 2, 3),
cov AS (
  SELECT experiment, variant, sum(user_cnt) AS n, sum(pre_metric_sum) AS m, sum(pre_metric_sq_sum) AS mm, sum(pre_cnt_sum) AS k, sum(pre_cnt_sq_sum) AS kk, sum(pre_metric_pre_cnt_cross_sum) AS mk, sum(pre_metric_post_cross_sum) AS my,
    sum(pre_cnt_post_cross_sum) AS ky, sum(post_metric_sum) AS y, sum(post_metric_sq_sum) AS yy FROM cov_daily GROUP BY 1, 2),
pair AS (
  SELECT t.experiment, t.variant, t.user_cnt AS nt, c.user_cnt AS nc, t.post_mean AS yt, c.post_mean AS yc, t.post_var AS vt, c.post_var AS vc, t.pre_mean AS xt, c.pre_mean AS xc, t.pre_var AS vxt, c.pre_var AS vxc, t.pre_post_cov AS kt, c.pre_post_cov AS kc,
    t.user_cnt + c.user_cnt AS np, t.pre_sum + c.pre_sum AS px, t.post_sum + c.post_sum AS py, t.pre_sq_sum + c.pre_sq_sum AS pxx, t.post_sq_sum + c.post_sq_sum AS pyy, t.pre_post_cross_sum + c.pre_post_cross_sum AS pxy
  FROM ads t JOIN ads c ON c.experiment = t.experiment AND c.variant = 'control' AND t.variant <> 'control'),
theta AS (SELECT *, (pxy - px * py / np) / (pxx - px * px / np) AS th, (pxy - px * py / np) / sqrt((pxx - px * px / np) * (pyy - py * py / np)) AS rho FROM pair),
clus AS (SELECT experiment, variant, cluster_id, CAST(sum(user_cnt) AS DOUBLE) AS n, sum(pre_sum) AS x, sum(post_sum) AS y, sum(post_sq_sum) AS yy FROM cluster_daily GROUP BY 1, 2, 3),
clus_arm AS (SELECT experiment, variant, count(*) AS g, avg(y / n) AS m, var_samp(y / n) AS v FROM clus GROUP BY 1, 2),
spine AS (SELECT k.experiment, k.variant, d.ds FROM (SELECT DISTINCT experiment, variant FROM dws) k
  JOIN (SELECT experiment, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM dws GROUP BY experiment) d USING (experiment)),
run AS (SELECT s.experiment, s.variant, s.ds, CAST(sum(coalesce(user_cnt, 0)) OVER w AS BIGINT) AS n, sum(coalesce(pre_sum, 0)) OVER w AS sum_x, sum(coalesce(post_sum, 0)) OVER w AS sum_y, sum(coalesce(pre_sq_sum, 0)) OVER w AS sum_xx,
    sum(coalesce(post_sq_sum, 0)) OVER w AS sum_yy, sum(coalesce(pre_post_cross_sum, 0)) OVER w AS sum_xy
  FROM spine s LEFT JOIN dws USING (experiment, variant, ds) WINDOW w AS (PARTITION BY s.experiment, s.variant ORDER BY s.ds)),
info AS (SELECT experiment, ds, sum(n) / max(sum(n)) OVER (PARTITION BY experiment) AS info FROM run GROUP BY experiment, ds),
near AS (SELECT experiment, ds, info, k, row_number() OVER (PARTITION BY experiment, k ORDER BY abs(info - k / 5.0), ds) AS r FROM info, (SELECT unnest(range(1, 6)) AS k)),
picks AS (SELECT experiment, min(ds) AS ds, info, row_number() OVER (PARTITION BY experiment ORDER BY info) AS look
  FROM (SELECT experiment, ds, info FROM near WHERE r = 1 UNION ALL SELECT experiment, max(ds), arg_max(info, ds) FROM info GROUP BY experiment) GROUP BY experiment, info),
look AS (SELECT t.experiment, p.look, p.info, t.sum_y / t.n - c.sum_y / c.n AS effect, sqrt((t.sum_yy - t.sum_y * t.sum_y / t.n) / (t.n - 1) / t.n + (c.sum_yy - c.sum_y * c.sum_y / c.n) / (c.n - 1) / c.n) AS se
  FROM picks p JOIN run t ON t.experiment = p.experiment AND t.ds = p.ds AND t.variant = 'treatment' JOIN run c ON c.experiment = p.experiment AND c.ds = p.ds AND c.variant = 'control' WHERE t.n > 1 AND c.n > 1),
panel AS (SELECT u.unit, y.period, u.cohort, coalesce(o.v, 0) AS outcome
  FROM (SELECT DISTINCT o_custkey AS unit, CASE o_custkey % 4 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 END AS cohort FROM orders) u CROSS JOIN (SELECT unnest(range(1, 8)) AS period) y
  LEFT JOIN (SELECT o_custkey AS unit, year(o_orderdate) - 1994 AS period, sum(CAST(o_totalprice AS DOUBLE)) AS v FROM orders GROUP BY 1, 2) o ON o.unit = u.unit AND o.period = y.period),
rd AS (SELECT (CAST(l_quantity AS DOUBLE) - 25.5) / 10 AS u, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem WHERE CAST(l_quantity AS DOUBLE) BETWEEN 15.5 AND 35.5),
scored AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS y, CAST(o_custkey % 2 AS DOUBLE) AS d, CAST(o_orderkey * 7919 % 1000 AS DOUBLE) AS score FROM orders),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk, count(*) OVER () AS total FROM scored),
qini AS (SELECT rk, total, sum(y * d) OVER w - CASE WHEN sum(1 - d) OVER w > 0 THEN sum(y * (1 - d)) OVER w * sum(d) OVER w / sum(1 - d) OVER w ELSE 0 END AS q FROM ranked WINDOW w AS (ORDER BY rk)),
points AS (SELECT DISTINCT CAST(floor(1 + i * (total - 1) / 99.0) AS BIGINT) AS rk FROM (SELECT unnest(range(0, 100)) AS i), (SELECT max(total) AS total FROM ranked))
"""


def sql(body: str) -> str:
    return f"WITH {CTES} {body}"


_SUMS = "user_cnt, round(post_sum, 4) AS post_sum, round(post_sq_sum, 4) AS post_sq_sum, round(pre_sum, 4) AS pre_sum, round(pre_sq_sum, 4) AS pre_sq_sum, round(pre_post_cross_sum, 4) AS pre_post_cross_sum"
_CNT = "CAST(post_event_cnt AS BIGINT) AS post_event_cnt, CAST(pre_event_cnt AS BIGINT) AS pre_event_cnt"
_WELCH = "round({e}, 4) AS effect, round(sqrt({a} + {b}), 4) AS std_error, round(({a} + {b}) * ({a} + {b}) / ({a} * {a} / ({da}) + {b} * {b} / ({db})), 4) AS df"


def _welch(e: str, a: str, b: str, da: str, db: str) -> str:
    return _WELCH.format(e=e, a=f"({a})", b=f"({b})", da=da, db=db)


_TV = lambda p, v: f"greatest({v} - 2 * th * k{p} + th * th * vx{p}, 0) / n{p}"
_RV = lambda p: f"greatest(({p}.yy - {p}.y * {p}.y / {p}.n) / ({p}.n - 1) - 2 * {p}.y / {p}.x * (({p}.xy - {p}.x * {p}.y / {p}.n) / ({p}.n - 1)) + ({p}.y / {p}.x) * ({p}.y / {p}.x) * (({p}.xx - {p}.x * {p}.x / {p}.n) / ({p}.n - 1)), 0) / ({p}.n * ({p}.x / {p}.n) * ({p}.x / {p}.n))"
_GV = lambda p: f"greatest(({p}.yy - {p}.y * {p}.y / {p}.n) / ({p}.n - 1), 0) / {p}.n"

ORACLES = {
    "ods_event_log": sql("SELECT ds, user_id, event_name, round(metric_value, 4) AS metric_value FROM ods_event_log"),
    "ods_exposure_log": sql("SELECT ds, ts, user_id, experiment, variant, layer FROM ods_exposure_log"),
    "ods_user_profile": sql("SELECT user_id, reg_ds, city FROM ods_user_profile"),
    "dim_experiment_config": sql("SELECT experiment, variant, design_weight, layer FROM dim_experiment_config"),
    "dim_guardrail_config": sql("SELECT experiment, guardrail, direction, max_harm FROM dim_guardrail_config"),
    "dwd_experiment_user": sql("SELECT experiment, variant, user_id, expose_ds, expose_ts, city, reg_ds, round(pre_metric, 4) AS pre_metric, CAST(pre_cnt AS BIGINT) AS pre_cnt, round(post_metric, 4) AS post_metric, CAST(post_cnt AS BIGINT) AS post_cnt FROM dwd"),
    "dws_experiment_variant_daily": sql(f"SELECT experiment, variant, ds, {_SUMS}, {_CNT} FROM dws"),
    "ads_experiment_result": sql(f"SELECT experiment, variant, layer, design_weight, {_SUMS}, round(post_mean, 4) AS post_mean, round(pre_mean, 4) AS pre_mean, round(post_var, 4) AS post_var, round(pre_var, 4) AS pre_var, round(pre_post_cov, 4) AS pre_post_cov FROM ads"),
    "ads_experiment_srm": sql(
        "SELECT experiment, variant, user_cnt, round(expected_cnt, 4) AS expected_cnt, round((user_cnt - expected_cnt) / nullif(expected_cnt, 0), 6) AS relative_deviation, round(power(user_cnt - expected_cnt, 2) / nullif(expected_cnt, 0), 6) AS chi2_component, "
        "count(*) OVER w - 1 AS degrees_of_freedom, round(sum(power(user_cnt - expected_cnt, 2) / nullif(expected_cnt, 0)) OVER w, 6) AS chi2_statistic FROM srm0 WINDOW w AS (PARTITION BY experiment)"
    ),
    "dws_experiment_cluster_daily": sql(f"SELECT experiment, variant, cluster_id, ds, {_SUMS}, {_CNT} FROM cluster_daily"),
    "dws_experiment_ratio_daily": sql("SELECT experiment, variant, ds, user_cnt, round(sum_y, 4) AS sum_y, CAST(sum_x AS BIGINT) AS sum_x, round(sum_yy, 4) AS sum_yy, CAST(sum_xx AS BIGINT) AS sum_xx, round(sum_xy, 4) AS sum_xy FROM ratio_daily"),
    "ads_experiment_ratio_result": sql("SELECT experiment, variant, CAST(n AS BIGINT) AS user_cnt, round(y, 4) AS sum_y, CAST(x AS BIGINT) AS sum_x, round(yy, 4) AS sum_yy, CAST(xx AS BIGINT) AS sum_xx, round(xy, 4) AS sum_xy FROM ratio"),
    "dws_experiment_guardrail_daily": sql("SELECT experiment, variant, ds, guardrail, user_cnt, round(value_sum, 4) AS value_sum, round(value_sq_sum, 4) AS value_sq_sum FROM guard_daily"),
    "ads_experiment_guardrail_result": sql("SELECT experiment, guardrail, variant, n AS user_cnt, round(y, 4) AS value_sum, round(yy, 4) AS value_sq_sum, round(y / nullif(n, 0), 4) AS value_mean FROM guard"),
    "dws_experiment_covariate_daily": sql(
        "SELECT experiment, variant, ds, user_cnt, round(pre_metric_sum, 4) AS pre_metric_sum, round(pre_metric_sq_sum, 4) AS pre_metric_sq_sum, CAST(pre_cnt_sum AS BIGINT) AS pre_cnt_sum, CAST(pre_cnt_sq_sum AS BIGINT) AS pre_cnt_sq_sum, round(pre_metric_pre_cnt_cross_sum, 4) AS pre_metric_pre_cnt_cross_sum, "
        "round(pre_metric_post_cross_sum, 4) AS pre_metric_post_cross_sum, round(pre_cnt_post_cross_sum, 4) AS pre_cnt_post_cross_sum, round(post_metric_sum, 4) AS post_metric_sum, round(post_metric_sq_sum, 4) AS post_metric_sq_sum FROM cov_daily"
    ),
    "ads_experiment_covariate_result": sql(
        "SELECT experiment, variant, CAST(n AS BIGINT) AS user_cnt, round(m, 4) AS pre_metric_sum, round(mm, 4) AS pre_metric_sq_sum, CAST(k AS BIGINT) AS pre_cnt_sum, CAST(kk AS BIGINT) AS pre_cnt_sq_sum, round(mk, 4) AS pre_metric_pre_cnt_cross_sum, round(my, 4) AS pre_metric_post_cross_sum, round(ky, 4) AS pre_cnt_post_cross_sum, "
        "round(y, 4) AS post_metric_sum, round(yy, 4) AS post_metric_sq_sum, round((mm - m * m / n) / (n - 1), 4) AS pre_metric_var, round((kk - k * k / n) / (n - 1), 4) AS pre_cnt_var, round((yy - y * y / n) / (n - 1), 4) AS post_metric_var, "
        "round((mk - m * k / n) / (n - 1), 4) AS pre_metric_pre_cnt_cov, round((my - m * y / n) / (n - 1), 4) AS pre_metric_post_cov, round((ky - k * y / n) / (n - 1), 4) AS pre_cnt_post_cov FROM cov"
    ),
    "welch_effect": sql(f"SELECT experiment, variant, {_welch('yt - yc', 'vt / nt', 'vc / nc', 'nt - 1', 'nc - 1')}, round((yt - yc) / yc, 6) AS relative_effect FROM pair"),
    "cuped_effect": sql(f"SELECT experiment, variant, {_welch('(yt - yc) - th * (xt - xc)', _TV('t', 'vt'), _TV('c', 'vc'), 'nt - 1', 'nc - 1')}, round(th, 6) AS theta, round(rho, 6) AS correlation, round((xt - xc) / sqrt(vxt / nt + vxc / nc), 6) AS pre_gap_z FROM theta"),
    "ratio_delta_effect": sql(f"SELECT t.experiment, t.variant, {_welch('t.y / t.x - c.y / c.x', _RV('t'), _RV('c'), 't.n - 1', 'c.n - 1')} FROM ratio t JOIN ratio c ON c.experiment = t.experiment AND c.variant = 'control' AND t.variant <> 'control'"),
    "cluster_level_effect": sql(f"SELECT t.experiment, t.variant, {_welch('t.m - c.m', 't.v / t.g', 'c.v / c.g', 't.g - 1', 'c.g - 1')} FROM clus_arm t JOIN clus_arm c ON c.experiment = t.experiment AND c.variant = 'control' AND t.variant <> 'control'"),
    "cluster_robust_effect": sql(
        "SELECT experiment, 'treatment' AS variant, round(y1 / n1 - y0 / n0, 4) AS effect, round(sqrt((ss0 / (n0 * n0) + ss1 / (n1 * n1)) * g / (g - 1) * (n1 + n0 - 1) / (n1 + n0 - 2)), 4) AS std_error, CAST(greatest(g - 2, 1) AS DOUBLE) AS df FROM "
        "(SELECT experiment, count(*) AS g, sum(CASE WHEN t THEN n END) AS n1, sum(CASE WHEN NOT t THEN n END) AS n0, sum(CASE WHEN t THEN y END) AS y1, sum(CASE WHEN NOT t THEN y END) AS y0, sum(CASE WHEN t THEN s * s END) AS ss1, sum(CASE WHEN NOT t THEN s * s END) AS ss0 "
        "FROM (SELECT experiment, variant <> 'control' AS t, n, y, y - n * sum(y) OVER w / sum(n) OVER w AS s FROM clus WINDOW w AS (PARTITION BY experiment, variant)) GROUP BY experiment)"
    ),
    "icc_components": sql(
        "SELECT experiment, g AS clusters, CAST(n AS BIGINT) AS units, round((b - y * y / n) / (g - 1), 4) AS ms_between, round((yy - b) / (n - g), 4) AS ms_within, round((n - nn / n) / (g - 1), 6) AS m0 FROM "
        "(SELECT experiment, count(*) AS g, sum(n) AS n, sum(n * n) AS nn, sum(y) AS y, sum(yy) AS yy, sum(y * y / n) AS b FROM (SELECT experiment, cluster_id, sum(n) AS n, sum(y) AS y, sum(yy) AS yy FROM clus GROUP BY 1, 2) GROUP BY experiment)"
    ),
    "mixed_clusters": sql("SELECT experiment, cluster_id, count(DISTINCT variant) AS arms FROM clus GROUP BY 1, 2 HAVING count(DISTINCT variant) > 1"),
    "guardrail_harm": sql(
        f"SELECT g.experiment, g.guardrail, t.variant, g.direction, g.max_harm, round(t.y / t.n - c.y / c.n, 6) AS harm, round(sqrt({_GV('t')} + {_GV('c')}), 6) AS std_error FROM dim_guardrail_config g "
        "JOIN guard t ON t.experiment = g.experiment AND t.guardrail = g.guardrail AND t.variant <> 'control' JOIN guard c ON c.experiment = g.experiment AND c.guardrail = g.guardrail AND c.variant = 'control'"
    ),
    "cumulative_looks": sql("SELECT experiment, variant, ds, n, round(sum_x, 4) AS sum_x, round(sum_y, 4) AS sum_y, round(sum_xx, 4) AS sum_xx, round(sum_yy, 4) AS sum_yy, round(sum_xy, 4) AS sum_xy FROM run"),
    "look_picks": sql("SELECT experiment, CAST(look AS INTEGER) AS look, ds, round(info, 6) AS info FROM picks"),
    "msprt_path": sql(
        "SELECT experiment, 'treatment' AS variant, CAST(look AS INTEGER) AS look, round(effect, 4) AS effect, round(se, 4) AS std_error, round(p, 6) AS p, round(min(p) OVER (PARTITION BY experiment ORDER BY look), 6) AS always_valid_p FROM "
        "(SELECT *, least(1.0, 1 / (sqrt(se * se / (se * se + 400)) * exp(effect * effect * 400 / (2 * se * se * (se * se + 400))))) AS p FROM look)"
    ),
    "posterior_mean_sd": sql("SELECT experiment, variant, round((e / v) / (1 / v + 1 / 2500.0), 4) AS posterior_mean, round(sqrt(1 / (1 / v + 1 / 2500.0)), 4) AS posterior_sd FROM (SELECT experiment, variant, yt - yc AS e, vt / nt + vc / nc AS v FROM pair)"),
    "salt_agreement": sql(
        "SELECT a.experiment AS left_experiment, b.experiment AS right_experiment, count(*) AS shared_users, round(avg(CASE WHEN a.variant = b.variant THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (SELECT DISTINCT experiment, variant, user_id FROM ods_exposure_log) a JOIN (SELECT DISTINCT experiment, variant, user_id FROM ods_exposure_log) b ON a.user_id = b.user_id AND a.experiment < b.experiment GROUP BY 1, 2"
    ),
    "arm_shares": sql("SELECT experiment, variant, user_cnt, round(user_cnt / sum(user_cnt) OVER (PARTITION BY experiment), 6) AS share FROM ads"),
    "repeated_exposures": sql("SELECT experiment, CAST(sum(n) - count(*) AS BIGINT) AS repeats FROM (SELECT experiment, variant, user_id, count(*) AS n FROM ods_exposure_log GROUP BY 1, 2, 3) GROUP BY experiment"),
    "undeclared_events": sql("SELECT event_name, count(*) AS rows FROM ods_event_log WHERE event_name NOT IN ('purchase', 'error') GROUP BY event_name"),
    "users_without_exposure": sql("SELECT DISTINCT user_id FROM ods_event_log WHERE user_id NOT IN (SELECT user_id FROM ods_exposure_log WHERE experiment = 'exp_city')"),
    "arm_switchers": sql("SELECT experiment, user_id, count(DISTINCT variant) AS arms FROM dwd GROUP BY 1, 2 HAVING count(DISTINCT variant) > 1"),
    "cross_layer": sql(
        "SELECT c AS \"check\", experiment, variant, round(d, 4) AS detail, round(s, 4) AS summary, abs(d - s) <= 1e-9 * greatest(abs(d), abs(s), 1) AS ok FROM (SELECT u.experiment, u.variant, unnest(['user_cnt', 'post_sum', 'pre_sum', 'pre_post_cross_sum']) AS c, "
        "unnest([u.n, u.y, u.x, u.xy]) AS d, unnest([CAST(a.user_cnt AS DOUBLE), a.post_sum, a.pre_sum, a.pre_post_cross_sum]) AS s FROM (SELECT experiment, variant, CAST(count(*) AS DOUBLE) AS n, sum(post_metric) AS y, sum(pre_metric) AS x, sum(pre_metric * post_metric) AS xy FROM dwd GROUP BY 1, 2) u JOIN ads a USING (experiment, variant))"
    ),
    "metric_shape": sql(
        "SELECT experiment, count(*) AS n, round(avg(post_metric), 4) AS mean, round(stddev_samp(post_metric), 4) AS sd, round(max(post_metric), 4) AS largest, round(avg(CASE WHEN post_metric = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(skewness(post_metric), 6) AS skewness, round(kurtosis(post_metric), 6) AS kurtosis FROM dwd GROUP BY experiment"
    ),
    "quarter_rollup": "SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, count(*) AS orders, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS revenue FROM orders GROUP BY 1",
    "did_two_by_two": sql(
        "SELECT round(a.m - b.m, 4) AS effect, round(sqrt(a.v / a.n + b.v / b.n), 4) AS std_error FROM (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM (SELECT unit, avg(CASE WHEN period >= 4 THEN outcome END) - avg(CASE WHEN period <= 3 THEN outcome END) AS x FROM panel WHERE cohort = 4 GROUP BY unit)) a, "
        "(SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM (SELECT unit, avg(CASE WHEN period >= 4 THEN outcome END) - avg(CASE WHEN period <= 3 THEN outcome END) AS x FROM panel WHERE cohort IS NULL GROUP BY unit)) b"
    ),
    "did_twfe": sql(
        "SELECT round(tau, 4) AS effect, round(sqrt(sum(s * s) / (max(dd) * max(dd)) * count(*) / (count(*) - 1)), 4) AS std_error FROM (SELECT unit, tau, dd, sum(d * (y - tau * d)) AS s FROM (SELECT unit, y, d, sum(y * d) OVER () / sum(d * d) OVER () AS tau, sum(d * d) OVER () AS dd FROM "
        "(SELECT unit, outcome - avg(outcome) OVER (PARTITION BY unit) - avg(outcome) OVER (PARTITION BY period) + avg(outcome) OVER () AS y, t - avg(t) OVER (PARTITION BY unit) - avg(t) OVER (PARTITION BY period) + avg(t) OVER () AS d "
        "FROM (SELECT unit, period, outcome, CASE WHEN period >= cohort THEN 1.0 ELSE 0.0 END AS t FROM panel))) GROUP BY unit, tau, dd) GROUP BY tau"
    ),
    "did_group_time": sql(
        "SELECT CAST(g AS BIGINT) AS cohort, CAST(t AS BIGINT) AS period, round(avg(CASE WHEN own THEN dy END) - avg(CASE WHEN NOT own THEN dy END), 4) AS effect, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS treated, CAST(sum(CASE WHEN NOT own THEN 1 ELSE 0 END) AS BIGINT) AS controls FROM "
        "(SELECT c.g, a.period AS t, a.cohort IS NOT NULL AND a.cohort = c.g AS own, a.outcome - b.outcome AS dy FROM (SELECT unnest([4, 5, 6]) AS g) c JOIN panel a ON a.period <> c.g - 1 JOIN panel b ON b.unit = a.unit AND b.period = c.g - 1 WHERE coalesce(a.cohort, 1000000) = c.g OR coalesce(a.cohort, 1000000) > greatest(a.period, c.g - 1)) GROUP BY g, t"
    ),
    "iv_wald": sql("SELECT round(covar_samp(y, z) / covar_samp(d, z), 4) AS effect, count(*) AS n FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS d, CAST(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS z FROM lineitem)"),
    "ols_line": sql("SELECT round(regr_intercept(y, x), 4) AS intercept, round(regr_slope(y, x), 6) AS slope FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem)"),
    "rdd_uniform": sql("SELECT round((SELECT regr_intercept(y, u) FROM rd WHERE u >= 0) - (SELECT regr_intercept(y, u) FROM rd WHERE u < 0), 4) AS effect, (SELECT count(*) FROM rd WHERE u < 0) AS n_left, (SELECT count(*) FROM rd WHERE u >= 0) AS n_right"),
    "qini_curve": sql("SELECT round(rk / total, 8) AS fraction, round(q, 2) AS qini FROM qini JOIN points USING (rk)"),
    "effect_by_group": sql("SELECT CAST(g AS INTEGER) AS \"group\", count(*) AS units, round(avg(gamma), 4) AS effect, round(stddev_samp(gamma) / sqrt(count(*)), 4) AS std_error FROM (SELECT floor((rk - 1) * 4 / total) + 1 AS g, d * y / 0.5 - (1 - d) * y / 0.5 AS gamma FROM (SELECT *, CAST(total AS DOUBLE) AS t FROM ranked)) GROUP BY g"),
    "policy_value": sql("SELECT round(avg(CASE WHEN score > 500 THEN g ELSE 0 END), 4) AS value, round(stddev_samp(CASE WHEN score > 500 THEN g ELSE 0 END) / sqrt(count(*)), 4) AS std_error, round(avg(CASE WHEN score > 500 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT *, d * y / 0.5 - (1 - d) * y / 0.5 AS g FROM scored)"),
    "top_share": sql("SELECT id, score FROM ranked WHERE rk <= round(total * 0.1)"),
    "rank_correlation": sql("SELECT round(corr(a, b), 6) AS rank_correlation FROM (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM scored)"),
}

# ---- distribution functions by quadrature ------------------------------------------
# An engine without them integrates the densities by Simpson's rule.

_STEPS = 2000


def _simpson(upper: str, density: str) -> str:
    """Integral from 0 to ``upper`` of a density of u."""
    u = f"(({upper}) * i / {_STEPS}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {weight} * {density.replace('@u', u)})) * ({upper}) / {3 * _STEPS}.0)"


def _cdf(x: str) -> str:
    return f"(0.5 + sign({x}) * {_simpson(f'abs({x})', 'exp(-0.5 * @u * @u)')} / sqrt(2 * pi()))"


def _two_sided(z: str) -> str:
    return f"(1 - 2 * {_simpson(f'abs({z})', 'exp(-0.5 * @u * @u)')} / sqrt(2 * pi()))"


def _t_p(t: str, v: str) -> str:
    scale = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi())"
    return f"(1 - 2 * {scale} * {_simpson(f'abs({t})', f'power(1 + @u * @u / {v}, -({v} + 1) / 2)')})"


def _chi2_p(x: str, df: str) -> str:
    log = f"({df} - 1) * ln(@u) - @u * @u / 2 - lgamma({df} / 2.0) - ({df} / 2.0 - 1) * ln(2)"
    return f"(1 - {_simpson(f'sqrt({x})', f'(CASE WHEN @u > 0 THEN exp({log}) WHEN {df} = 1 THEN sqrt(2 / pi()) ELSE 0 END)')})"


def _t_quantile(z: float, v: str) -> str:
    """Expansion in 1 / v, for degrees of freedom of users."""
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join([repr(z), *[f"{c!r} / power({v}, {k})" for k, c in enumerate(terms, 1)]]) + ")"


Z975, Z80 = 1.959963984540054, 0.8416212335729143
_E = "round({0}, 4) AS {0}"
_r4 = lambda *names: ", ".join(_E.format(n) for n in names)
_PAIR_SUMS = "effect, sqrt({a} + {b}) AS std_error, ({a} + {b}) * ({a} + {b}) / ({a} * {a} / (nt - 1) + {b} * {b} / (nc - 1)) AS df"
_WELCH_ROWS = f"(SELECT experiment, variant, relative_effect, {_PAIR_SUMS.format(a='(vt / nt)', b='(vc / nc)')} FROM (SELECT *, yt - yc AS effect, (yt - yc) / yc AS relative_effect FROM pair))"
_CUPED_ROWS = (
    f"(SELECT experiment, variant, relative_effect, th AS theta, rho AS correlation, xt - xc AS pre_gap, (xt - xc) / sqrt(vxt / nt + vxc / nc) AS pre_gap_z, yt - yc AS naive_effect, {_PAIR_SUMS.format(a='(' + _TV('t', 'vt') + ')', b='(' + _TV('c', 'vc') + ')')} "
    "FROM (SELECT *, (yt - yc) - th * (xt - xc) AS effect, ((yt - yc) - th * (xt - xc)) / yc AS relative_effect FROM theta))"
)
_TESTED = "*, effect / std_error AS t_statistic, {q} * std_error AS half, abs(effect / std_error) AS shift".format(q=_t_quantile(Z975, "df"))


def _tested(rows: str) -> str:
    """Adds p-value, interval, power to rows of effect, std_error, df."""
    p = _t_p("t_statistic", "df")
    power = f"1 - {_cdf(f'({Z975} - shift)')} + {_cdf(f'(-{Z975} - shift)')}"
    return f"(SELECT *, {p} AS p_value, effect - half AS ci_low, effect + half AS ci_high, {Z975 + Z80} * std_error AS mde, {power} AS power FROM (SELECT {_TESTED} FROM {rows}))"


_TEST_COLUMNS = "experiment, variant, " + _r4("effect", "std_error", "df", "t_statistic", "ci_low", "ci_high", "mde", "power", "relative_effect") + ", round(p_value, 8) AS p_value, p_value < 0.05 AS significant"
_BALANCE = "CASE WHEN pre_gap_p IS NULL THEN 'unknown' WHEN pre_gap_p < 0.001 THEN 'warn' ELSE 'pass' END"
_SRM_ROWS = (
    f"(SELECT experiment, units, least_expected, chi2, df, CASE WHEN units > 0 AND least_expected >= 5 THEN {_chi2_p('chi2', 'df')} END AS p_value FROM "
    "(SELECT experiment, CAST(sum(user_cnt) AS BIGINT) AS units, min(expected_cnt) AS least_expected, sum(power(user_cnt - expected_cnt, 2) / nullif(expected_cnt, 0)) AS chi2, count(*) - 1 AS df FROM srm0 GROUP BY experiment))"
)
_SRM_STATUS = "CASE WHEN units = 0 THEN 'fail' WHEN p_value IS NULL THEN 'warn' WHEN p_value < 0.001 THEN 'fail' ELSE 'pass' END"
_HARM = (
    f"(SELECT g.experiment, g.guardrail, t.variant, g.direction, g.max_harm, t.y / t.n - c.y / c.n AS harm, sqrt({_GV('t')} + {_GV('c')}) AS std_error, power({_GV('t')} + {_GV('c')}, 2) / (power({_GV('t')}, 2) / (t.n - 1) + power({_GV('c')}, 2) / (c.n - 1)) AS df, "
    "0.05 / count(*) OVER (PARTITION BY g.experiment) AS alpha_each FROM dim_guardrail_config g JOIN guard t ON t.experiment = g.experiment AND t.guardrail = g.guardrail AND t.variant <> 'control' JOIN guard c ON c.experiment = g.experiment AND c.guardrail = g.guardrail AND c.variant = 'control')"
)
#: One guardrail an experiment here: alpha_each is 0.05.
_VERDICTS = f"(SELECT *, harm - half AS harm_low, harm + half AS harm_high, CASE WHEN harm - half > max_harm THEN 'fail' WHEN harm > max_harm THEN 'warn' ELSE 'pass' END AS status FROM (SELECT *, {_t_quantile(Z975, 'df')} * std_error AS half FROM {_HARM}))"
_POST = "(SELECT experiment, variant, e AS effect, sqrt(v) AS std_error, (e / v) / (1 / v + 1 / 2500.0) AS posterior_mean, sqrt(1 / (1 / v + 1 / 2500.0)) AS posterior_sd FROM (SELECT experiment, variant, yt - yc AS e, vt / nt + vc / nc AS v FROM pair))"
_PATH = "(SELECT *, least(1.0, 1 / (sqrt(se * se / (se * se + 400)) * exp(effect * effect * 400 / (2 * se * se * (se * se + 400))))) AS p FROM look)"

ORACLES |= {
    "welch_test": sql(f"SELECT {_TEST_COLUMNS} FROM {_tested(_WELCH_ROWS)}"),
    "cuped_test": sql(
        f"SELECT {_TEST_COLUMNS}, {_r4('theta', 'correlation', 'pre_gap', 'pre_gap_z', 'naive_effect', 'pre_gap_p')}, round(rho2, 4) AS variance_reduction, round(1 - sqrt(1 - rho2), 4) AS se_shrinkage, round(1 / (1 - rho2), 4) AS effective_sample_multiplier, abs(correlation) < 0.1 AS weak_covariate, {_BALANCE} AS balance "
        f"FROM (SELECT *, correlation * correlation AS rho2, {_two_sided('pre_gap_z')} AS pre_gap_p FROM {_tested(_CUPED_ROWS)})"
    ).replace(", round(mde, 4) AS mde, round(power, 4) AS power", ""),
    "sample_ratio_test": sql(f"SELECT experiment, units, {_r4('least_expected', 'chi2')}, df, round(p_value, 8) AS p_value, {_SRM_STATUS} AS status FROM {_SRM_ROWS}"),
    "sample_ratio_info": sql("SELECT experiment, variant, user_cnt AS n, round(user_cnt / sum(user_cnt) OVER (PARTITION BY experiment), 6) AS share, 'info' AS status FROM ads"),
    "guardrail_verdicts": sql(f"SELECT experiment, guardrail, variant, direction, max_harm, status, {_r4('harm', 'std_error', 'df', 'alpha_each', 'harm_low', 'harm_high')} FROM {_VERDICTS}"),
    "bayesian_decision": sql(
        "SELECT *, CASE WHEN greatest(probability_better, 1 - probability_better) < 0.95 AND least(loss_ship, loss_keep) > 0.5 THEN 'continue' WHEN loss_ship <= loss_keep THEN 'ship' ELSE 'keep' END AS action FROM "
        f"(SELECT experiment, variant, {_r4('effect', 'std_error', 'posterior_mean', 'posterior_sd')}, round(better, 4) AS probability_better, round(posterior_sd * phi - posterior_mean * (1 - better), 4) AS loss_ship, round(posterior_sd * phi + posterior_mean * better, 4) AS loss_keep "
        f"FROM (SELECT *, {_cdf('(posterior_mean / posterior_sd)')} AS better, exp(-0.5 * power(posterior_mean / posterior_sd, 2)) / sqrt(2 * pi()) AS phi FROM {_POST}))"
    ),
    "two_proportions": sql(
        f"SELECT experiment, variant, round(effect, 6) AS effect, round(se, 6) AS std_error, round(effect - {Z975} * own, 6) AS ci_low, round(effect + {Z975} * own, 6) AS ci_high, round(effect / se, 6) AS z_statistic, round({_two_sided('(effect / se)')}, 6) AS p_value FROM "
        "(SELECT t.experiment, t.variant, t.s / t.n - c.s / c.n AS effect, sqrt((t.s + c.s) / (t.n + c.n) * (1 - (t.s + c.s) / (t.n + c.n)) * (1.0 / t.n + 1.0 / c.n)) AS se, sqrt(t.s / t.n * (1 - t.s / t.n) / t.n + c.s / c.n * (1 - c.s / c.n) / c.n) AS own "
        "FROM (SELECT experiment, variant, count(*) AS n, sum(CASE WHEN post_cnt > 0 THEN 1.0 ELSE 0 END) AS s FROM dwd GROUP BY 1, 2) t JOIN (SELECT experiment, variant, count(*) AS n, sum(CASE WHEN post_cnt > 0 THEN 1.0 ELSE 0 END) AS s FROM dwd GROUP BY 1, 2) c ON c.experiment = t.experiment AND c.variant = 'control' AND t.variant <> 'control')"
    ),
    "unit_ratio": sql("SELECT experiment, variant, count(*) FILTER (post_cnt > 0) AS n, CAST(0 AS DOUBLE) AS sum_x, round(sum(post_metric / post_cnt) FILTER (post_cnt > 0), 4) AS sum_y, CAST(0 AS DOUBLE) AS sum_xx, round(sum(power(post_metric / post_cnt, 2)) FILTER (post_cnt > 0), 4) AS sum_yy, CAST(0 AS DOUBLE) AS sum_xy, count(*) FILTER (post_cnt <= 0) AS without_x FROM dwd GROUP BY 1, 2"),
    "unit_ratio_gap": sql(
        "SELECT u.experiment, u.variant, round(u.e, 4) AS unit_effect, round(r.e, 4) AS effect, round(u.e - r.e, 4) AS gap, round((u.e - r.e) / abs(r.e), 6) AS relative_gap FROM "
        "(SELECT t.experiment, t.variant, t.m - c.m AS e FROM (SELECT experiment, variant, avg(post_metric / post_cnt) AS m FROM dwd WHERE post_cnt > 0 GROUP BY 1, 2) t JOIN (SELECT experiment, variant, avg(post_metric / post_cnt) AS m FROM dwd WHERE post_cnt > 0 GROUP BY 1, 2) c ON c.experiment = t.experiment AND c.variant = 'control' AND t.variant <> 'control') u "
        "JOIN (SELECT t.experiment, t.variant, t.y / t.x - c.y / c.x AS e FROM ratio t JOIN ratio c ON c.experiment = t.experiment AND c.variant = 'control' AND t.variant <> 'control') r ON r.experiment = u.experiment AND r.variant = u.variant"
    ),
    "multivariate_cuped": sql(
        "SELECT experiment, round(t1, 6) AS theta_pre_metric, round(t2, 4) AS theta_pre_cnt, round(((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b)) / ((a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b)), 4) AS condition_number, round((t1 * c + t2 * e) / v, 6) AS variance_reduction, "
        "round(greatest(c * c / (a * v), e * e / (d * v)), 6) AS best_single_reduction, round((t1 * c + t2 * e) / v - greatest(c * c / (a * v), e * e / (d * v)), 6) AS extra_reduction FROM (SELECT *, (d * c - b * e) / (a * d - b * b) AS t1, (a * e - b * c) / (a * d - b * b) AS t2 FROM "
        "(SELECT experiment, var_pop(pre_metric) AS a, covar_pop(pre_metric, pre_cnt) AS b, var_pop(pre_cnt) AS d, covar_pop(pre_metric, post_metric) AS c, covar_pop(pre_cnt, post_metric) AS e, var_pop(post_metric) AS v FROM dwd GROUP BY experiment))"
    ),
    "cross_fitted_cuped": sql(
        "SELECT experiment, CAST(5 AS INTEGER) AS folds, round(var_pop(z), 4) AS adjusted_variance, round(1 - var_pop(z) / var_pop(y), 6) AS variance_reduction FROM (SELECT u.experiment, y, y - t1 * (x - mx) - t2 * (k - mk) AS z FROM "
        "(SELECT experiment, CAST(user_id AS BIGINT) % 5 AS fold, post_metric AS y, pre_metric AS x, CAST(pre_cnt AS DOUBLE) AS k, avg(pre_metric) OVER w AS mx, avg(pre_cnt) OVER w AS mk FROM dwd WINDOW w AS (PARTITION BY experiment)) u JOIN "
        "(SELECT experiment, fold, (d * c - b * e) / (a * d - b * b) AS t1, (a * e - b * c) / (a * d - b * b) AS t2 FROM (SELECT experiment, fold, var_pop(pre_metric) AS a, covar_pop(pre_metric, pre_cnt) AS b, var_pop(pre_cnt) AS d, covar_pop(pre_metric, post_metric) AS c, covar_pop(pre_cnt, post_metric) AS e "
        "FROM dwd, (SELECT unnest(range(0, 5)) AS fold) WHERE CAST(user_id AS BIGINT) % 5 <> fold GROUP BY 1, 2)) f USING (experiment, fold)) GROUP BY experiment"
    ),
    "cluster_cuped_effect": sql(
        f"SELECT experiment, variant, {_r4('effect', 'std_error', 'df')}, round(theta, 6) AS theta FROM (SELECT experiment, variant, th AS theta, {_PAIR_SUMS.format(a='va', b='vb')} FROM (SELECT *, (yt - yc) - th * (xt - xc) AS effect, greatest(vt - 2 * th * kt + th * th * vxt, 0) / nt AS va, greatest(vc - 2 * th * kc + th * th * vxc, 0) / nc AS vb FROM "
        "(SELECT t.experiment, t.variant, t.n AS nt, c.n AS nc, t.y AS yt, c.y AS yc, t.x AS xt, c.x AS xc, t.v AS vt, c.v AS vc, t.vx AS vxt, c.vx AS vxc, t.k AS kt, c.k AS kc, p.th FROM m t JOIN m c ON c.experiment = t.experiment AND c.variant = 'control' AND t.variant <> 'control' "
        "JOIN (SELECT experiment, covar_samp(x / n, y / n) / var_samp(x / n) AS th FROM clus GROUP BY experiment) p ON p.experiment = t.experiment)))"
    ).replace(" FROM m t JOIN m c", " FROM (SELECT experiment, variant, count(*) AS n, avg(y / n) AS y, avg(x / n) AS x, var_samp(y / n) AS v, var_samp(x / n) AS vx, covar_samp(x / n, y / n) AS k FROM clus GROUP BY 1, 2) t JOIN (SELECT experiment, variant, count(*) AS n, avg(y / n) AS y, avg(x / n) AS x, var_samp(y / n) AS v, var_samp(x / n) AS vx, covar_samp(x / n, y / n) AS k FROM clus GROUP BY 1, 2) c"),
    "cluster_pass_through": sql("SELECT experiment, count(DISTINCT city) AS clusters, count(DISTINCT user_id) AS users FROM dwd WHERE experiment LIKE 'exp_%' AND city IS NOT NULL GROUP BY experiment"),
    "experiment_report": sql(
        f"SELECT c.experiment, c.variant, {', '.join(f'round(c.{n}, 4) AS {n}' for n in ('effect', 'std_error', 'ci_low', 'ci_high', 'naive_effect', 'theta', 'mde', 'power'))}, round(c.p_value, 8) AS p_value, round(w.std_error, 4) AS plain_std_error, round(w.p_value, 4) AS plain_p_value, round(c.theta * c.pre_gap, 4) AS covariate_shift, "
        "round(c.correlation * c.correlation, 4) AS variance_reduction, s.status AS sample_ratio, round(s.p_value, 4) AS sample_ratio_p, coalesce(g.verdict, 'unknown') AS guardrails, c.balance, round(v.p, 4) AS always_valid_p, "
        "CASE WHEN s.status = 'fail' OR g.verdict = 'stop' THEN 'fail' WHEN s.status = 'warn' OR g.verdict = 'watch' OR c.balance = 'warn' THEN 'warn' ELSE 'pass' END AS health "
        f"FROM (SELECT *, {_BALANCE} AS balance FROM (SELECT *, {_two_sided('pre_gap_z')} AS pre_gap_p FROM {_tested(_CUPED_ROWS)})) c JOIN {_tested(_WELCH_ROWS)} w ON w.experiment = c.experiment AND w.variant = c.variant "
        f"LEFT JOIN (SELECT *, {_SRM_STATUS} AS status FROM {_SRM_ROWS}) s ON s.experiment = c.experiment LEFT JOIN (SELECT experiment, CASE WHEN bool_or(status = 'fail') THEN 'stop' WHEN bool_or(status = 'warn') THEN 'watch' ELSE 'ok' END AS verdict FROM {_VERDICTS} GROUP BY experiment) g ON g.experiment = c.experiment "
        f"LEFT JOIN (SELECT experiment, min(p) AS p FROM {_PATH} GROUP BY experiment) v ON v.experiment = c.experiment"
    ),
    "cuped_looks": sql(
        "SELECT experiment, variant, CAST(look AS INTEGER) AS look, round(info, 6) AS info, round(t.ey - c.ey - th * (t.ex - c.ex), 4) AS effect, round(sqrt(greatest(t.v - 2 * th * t.k + th * th * t.vx, 0) / t.n + greatest(c.v - 2 * th * c.k + th * th * c.vx, 0) / c.n), 4) AS std_error FROM (SELECT p.experiment, 'treatment' AS variant, p.look, p.info, "
        + ", ".join(f"struct_pack(n := {a}.n, ey := {a}.sum_y / {a}.n, ex := {a}.sum_x / {a}.n, v := ({a}.sum_yy - {a}.sum_y * {a}.sum_y / {a}.n) / ({a}.n - 1), vx := ({a}.sum_xx - {a}.sum_x * {a}.sum_x / {a}.n) / ({a}.n - 1), k := ({a}.sum_xy - {a}.sum_x * {a}.sum_y / {a}.n) / ({a}.n - 1)) AS {b}" for a, b in (("rt", "t"), ("rc", "c")))
        + ", ((rt.sum_xy + rc.sum_xy) - (rt.sum_x + rc.sum_x) * (rt.sum_y + rc.sum_y) / (rt.n + rc.n)) / ((rt.sum_xx + rc.sum_xx) - power(rt.sum_x + rc.sum_x, 2) / (rt.n + rc.n)) AS th "
        "FROM picks p JOIN run rt ON rt.experiment = p.experiment AND rt.ds = p.ds AND rt.variant = 'treatment' JOIN run rc ON rc.experiment = p.experiment AND rc.ds = p.ds AND rc.variant = 'control' WHERE rt.n > 1 AND rc.n > 1)"
    ),
    "cluster_looks": sql(
        "SELECT r.experiment, r.ds, r.variant, r.cluster_id, r.n, round(r.sum_x, 4) AS sum_x, round(r.sum_y, 4) AS sum_y, round(r.sum_xx, 4) AS sum_xx, round(r.sum_yy, 4) AS sum_yy, round(r.sum_xy, 4) AS sum_xy, CAST(p.look AS INTEGER) AS look, round(p.info, 6) AS info FROM crun r JOIN "
        "(SELECT experiment, min(ds) AS ds, info, row_number() OVER (PARTITION BY experiment ORDER BY info) AS look FROM (SELECT experiment, ds, info FROM (SELECT *, row_number() OVER (PARTITION BY experiment, k ORDER BY abs(info - k / 3.0), ds) AS r FROM cinfo, (SELECT unnest(range(1, 4)) AS k)) WHERE r = 1 "
        "UNION ALL SELECT experiment, max(ds), arg_max(info, ds) FROM cinfo GROUP BY experiment) GROUP BY experiment, info) p ON p.experiment = r.experiment AND p.ds = r.ds"
    ).replace(
        " SELECT r.experiment", ", crun AS (SELECT * FROM (SELECT k.experiment, k.variant, k.cluster_id, d.ds, CAST(sum(coalesce(user_cnt, 0)) OVER w AS BIGINT) AS n, sum(coalesce(pre_sum, 0)) OVER w AS sum_x, sum(coalesce(post_sum, 0)) OVER w AS sum_y, sum(coalesce(pre_sq_sum, 0)) OVER w AS sum_xx, sum(coalesce(post_sq_sum, 0)) OVER w AS sum_yy, sum(coalesce(pre_post_cross_sum, 0)) OVER w AS sum_xy "
        "FROM (SELECT DISTINCT experiment, variant, cluster_id FROM cluster_daily) k JOIN (SELECT experiment, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM cluster_daily GROUP BY experiment) d USING (experiment) LEFT JOIN cluster_daily c ON c.experiment = k.experiment AND c.variant = k.variant AND c.cluster_id = k.cluster_id AND c.ds = d.ds "
        "WINDOW w AS (PARTITION BY k.experiment, k.variant, k.cluster_id ORDER BY d.ds)) WHERE n > 0), cinfo AS (SELECT experiment, ds, c / max(c) OVER (PARTITION BY experiment) AS info FROM (SELECT experiment, ds, sum(c) AS c, min(c) AS least, count(*) AS arms FROM (SELECT experiment, variant, ds, count(*) AS c FROM crun GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE least >= 2 AND arms >= 2) SELECT r.experiment", 1
    ),
    "users_of_both_halves": sql("SELECT event_name, count(*) AS rows, round(sum(metric_value), 4) AS value FROM ods_event_log WHERE day(ds) <= 15 AND user_id IN (SELECT user_id FROM ods_event_log WHERE day(ds) > 15) GROUP BY event_name"),
    "days_since_first_seen": sql("SELECT CAST(date_diff('day', f, ds) AS INTEGER) AS day, count(*) AS rows, count(DISTINCT user_id) AS users FROM (SELECT *, min(ds) OVER (PARTITION BY user_id) AS f FROM ods_event_log) GROUP BY 1"),
    "median_split": sql("SELECT experiment, variant, round(max(m), 4) AS median, count(*) FILTER (pre_metric > m) AS above, count(*) AS users FROM (SELECT *, median(pre_metric) OVER (PARTITION BY experiment, variant) AS m FROM dwd) GROUP BY 1, 2"),
    "live_shares": sql("SELECT experiment, variant, count(*) AS users, count(*) FILTER (post_metric > 0) AS live, round(avg(CASE WHEN post_metric > 0 THEN 1.0 ELSE 0 END), 6) AS live_share FROM dwd GROUP BY 1, 2"),
    "declared_lifts": sql("SELECT experiment, count(*) AS arms, CAST(0 AS BIGINT) AS declared FROM dim_experiment_config GROUP BY experiment"),
    "list_experiments": sql("SELECT e.experiment, 'default' AS layer, arms, users, first_ds, last_ds, CAST(CASE WHEN g.experiment IS NULL THEN 0 ELSE 1 END AS INTEGER) AS has_guardrails FROM (SELECT experiment, count(DISTINCT variant) AS arms, count(DISTINCT user_id) AS users, min(ds) AS first_ds, max(ds) AS last_ds FROM ods_exposure_log GROUP BY experiment) e LEFT JOIN dim_guardrail_config g ON g.experiment = e.experiment"),
    "retried_exposures": sql("SELECT experiment, variant, count(*) AS users, min(expose_ts) AS first_ts, max(expose_ts) AS last_ts FROM expo GROUP BY 1, 2"),
    "switched_arms": sql("SELECT 'broken' AS experiment, user_id, CAST(2 AS BIGINT) AS arms FROM ods_event_log GROUP BY user_id HAVING count(DISTINCT day(ds) % 2) > 1"),
    "did_twfe_weights": sql(
        "SELECT CAST(cohort AS BIGINT) AS cohort, CAST(period AS INTEGER) AS period, round(sum(d) / max(dd), 6) AS weight FROM (SELECT *, sum(d * d) OVER () AS dd FROM (SELECT cohort, period, t - avg(t) OVER (PARTITION BY unit) - avg(t) OVER (PARTITION BY period) + avg(t) OVER () AS d FROM (SELECT unit, period, cohort, CASE WHEN period >= cohort THEN 1.0 ELSE 0.0 END AS t FROM panel))) WHERE period >= cohort GROUP BY 1, 2"
    ),
    "qini_area": sql(
        "SELECT round(a, 2) AS auuc, round(b, 2) AS auuc_random, round(a - b, 2) AS qini_coefficient FROM (SELECT sum((f - pf) * (q + pq) / 2) AS a, sum((f - pf) * arg_end * (2 * i - 3) / (k - 1) / 2) AS b FROM (SELECT f, q, lag(f) OVER w AS pf, lag(q) OVER w AS pq, row_number() OVER w AS i, count(*) OVER () AS k, first_value(q) OVER (ORDER BY f DESC) AS arg_end "
        "FROM (SELECT rk / total AS f, q FROM qini JOIN points USING (rk)) WINDOW w AS (ORDER BY f)))"
    ),
    "policy_bounds": sql(" UNION ALL ".join(f"SELECT '{n}' AS policy, round(avg(v), 4) AS value, round(stddev_samp(v) / sqrt(count(*)), 4) AS std_error, round(avg(s), 6) AS share FROM (SELECT CASE WHEN {c} THEN g ELSE 0 END AS v, CASE WHEN {c} THEN 1.0 ELSE 0.0 END AS s FROM (SELECT d * y / 0.5 - (1 - d) * y / 0.5 AS g FROM scored))" for n, c in (("all", "true"), ("none", "false"), ("positive", "g > 0")))),
    "conformal_intervals": sql(
        "SELECT d, count(*) AS units, round(avg(2 * m), 4) AS width, round(avg(e - m), 4) AS mean_low, round(avg(e + m), 4) AS mean_high FROM (SELECT s.d, CASE WHEN s.d = 1 THEN y - 150000 ELSE 150000 + score - y END AS e, q.m FROM scored s JOIN (SELECT 1 - d AS d, min(r) AS m FROM "
        "(SELECT d, r, sum(w) OVER (PARTITION BY d ORDER BY r) / sum(w) OVER (PARTITION BY d) AS c, least(1.0, 0.9 * (1 + 1.0 / count(*) OVER (PARTITION BY d))) AS level FROM (SELECT d, abs(y - CASE WHEN d = 1 THEN 150000 + score ELSE 150000 END) AS r, CASE WHEN d = 1 THEN (1 - p) / p ELSE p / (1 - p) END AS w FROM (SELECT *, 0.25 + id % 3 / 4.0 AS p FROM scored) WHERE id % 2 = 0)) WHERE c >= level - 1e-12 GROUP BY d) q ON q.d = s.d) GROUP BY d"
    ),
}

# ---- effects with influence functions -------------------------------------------------

_SPEC = """spec AS (
  SELECT 'group_time' AS est, t - g AS k, g, t, g - 1 AS b, greatest(t, g - 1) AS lim FROM gs, ts WHERE t <> g - 1
  UNION ALL SELECT 'group_time_overall', NULL, g, t, g - 1, t FROM gs, ts WHERE t >= g
  UNION ALL SELECT 'interaction_weighted', t - g, g, t, g - 1, 999999 FROM gs, ts WHERE t <> g - 1
  UNION ALL SELECT 'interaction_weighted_overall', NULL, g, t, g - 1, 999999 FROM gs, ts WHERE t >= g
  UNION ALL SELECT 'switchers', 0, g, g, g - 1, g FROM gs UNION ALL SELECT 'switchers_placebo', -1, g, g - 1, g - 2, g FROM gs),
dy AS (SELECT s.est, s.k, s.g, s.t, a.unit, a.cohort IS NOT NULL AND a.cohort = s.g AS own, a.outcome - b.outcome AS x FROM spec s JOIN panel a ON a.period = s.t JOIN panel b ON b.period = s.b AND b.unit = a.unit
  WHERE (a.cohort IS NOT NULL AND a.cohort = s.g) OR coalesce(a.cohort, 1000000) > s.lim),
cell AS (SELECT est, k, g, t, count(*) FILTER (own) AS n1, avg(x) FILTER (own) AS m1, count(*) FILTER (NOT own) AS n0, avg(x) FILTER (NOT own) AS m0 FROM dy GROUP BY ALL HAVING count(*) FILTER (NOT own) >= 2),
weighed AS (SELECT *, n1 / sum(n1) OVER (PARTITION BY est, k) AS w FROM cell),
units AS (SELECT count(DISTINCT unit) AS n FROM panel),
psi AS (SELECT c.est, c.k, d.unit, sum(c.w * CASE WHEN d.own THEN u.n / c.n1 * (d.x - c.m1) ELSE -u.n / c.n0 * (d.x - c.m0) END) AS p FROM dy d JOIN weighed c ON c.est = d.est AND c.k IS NOT DISTINCT FROM d.k AND c.g = d.g AND c.t = d.t, units u GROUP BY ALL),
studied AS (SELECT e.est, e.k, e.effect, sqrt(s.ss / (u.n - 1) / u.n) AS std_error, CAST(u.n - 1 AS DOUBLE) AS df FROM (SELECT est, k, sum(w * (m1 - m0)) AS effect FROM weighed GROUP BY ALL) e JOIN (SELECT est, k, sum(p * p) AS ss FROM psi GROUP BY ALL) s ON s.est = e.est AND s.k IS NOT DISTINCT FROM e.k, units u)"""
_GS = "gs AS (SELECT unnest([4, 5, 6]) AS g), ts AS (SELECT unnest(range(1, 8)) AS t), "
_STUDY = f"coalesce(CAST(k AS VARCHAR), 'all') AS k, {_r4('effect', 'std_error')}, round({_t_p('(effect / std_error)', 'df')}, 8) AS p_value, round(effect - {_t_quantile(Z975, 'df')} * std_error, 4) AS ci_low, round(effect + {_t_quantile(Z975, 'df')} * std_error, 4) AS ci_high"
_WITH_STUDY = f"WITH {CTES}, {_GS}{_SPEC} "

ORACLES |= {
    "did_event_study": f"{_WITH_STUDY} SELECT est AS estimator, {_STUDY} FROM studied",
    "did_saturated_regression": f"{_WITH_STUDY} SELECT {_STUDY} FROM studied WHERE est IN ('interaction_weighted', 'interaction_weighted_overall')",
    "did_trend_breakdown": f"{_WITH_STUDY}, ev AS (SELECT k, sum(w * (m1 - m0)) AS e, sum(n1) AS n FROM weighed WHERE est = 'group_time' GROUP BY k), "
    "post AS (SELECT sum(n * e) / sum(n) AS effect, sum(n * (k + 1)) / sum(n) AS reach FROM ev WHERE k >= 0), step AS (SELECT k, abs(e - lag(e) OVER (ORDER BY k)) AS s FROM (SELECT k, e FROM ev WHERE k < 0 UNION ALL SELECT -1, 0.0)), "
    "bend AS (SELECT abs(s - lag(s) OVER (ORDER BY k)) AS b FROM step WHERE s IS NOT NULL) SELECT round(effect, 4) AS effect, round(effect / reach, 4) AS linear_breakdown, round(abs(effect) / ((SELECT max(s) FROM step) * reach), 6) AS relative_magnitude_breakdown, round((SELECT max(b) FROM bend), 4) AS smoothness_observed FROM post",
}

ORACLES["did_trend_sensitivity"] = (
    f"{_WITH_STUDY}, ev AS (SELECT k, sum(w * (m1 - m0)) AS e, sum(n1) AS n FROM weighed WHERE est = 'group_time' GROUP BY k), o AS (SELECT effect, std_error FROM studied WHERE est = 'group_time_overall'), "
    "gr AS (SELECT unnest(['relative', 'linear', 'smoothness']) AS restriction, unnest([1.0, sum(n * (k + 1)) / sum(n), sum(n * (k + 1) * (k + 2) / 2) / sum(n)]) AS g FROM ev WHERE k >= 0), mx AS (SELECT max(abs(e)) AS largest FROM ev WHERE k < 0) "
    f"SELECT restriction, multiple, round(effect, 4) AS effect, round(multiple * largest * g, 2) AS bias, round(effect - multiple * largest * g - {Z975} * std_error, 2) AS low, round(effect + multiple * largest * g + {Z975} * std_error, 2) AS high, round(abs(effect) / g, 4) AS breakdown, abs(effect) > multiple * largest * g + {Z975} * std_error AS robust "
    "FROM gr, mx, o, (SELECT unnest([CAST(0.5 AS DOUBLE), 1.0, 2.0]) AS multiple)"
)

_IV_SUMS = ", ".join(f"sum({a} * {b}{c}) AS {n}" for n, a, b, c in (("s11", "u", "u", ""), ("s12", "u", "w", ""), ("s22", "w", "w", ""), ("u1", "u", "x", ""), ("u2", "w", "x", ""), ("v1", "u", "y", ""), ("v2", "w", "y", ""),
    *((f"{p}{i}", a, b, f" * {q}") for i, a, b in (("11", "u", "u"), ("12", "u", "w"), ("22", "w", "w")) for p, q in (("yy", "y * y"), ("yd", "y * x"), ("dd", "x * x")))))
ORACLES["iv_interval"] = (
    "WITH l AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x, CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS z, CAST(l_partkey % 5 AS DOUBLE) AS z2 FROM lineitem), "
    "c AS (SELECT y - avg(y) OVER () AS y, x - avg(x) OVER () AS x, z - avg(z) OVER () AS u, z2 - avg(z2) OVER () AS w FROM l), "
    f"s AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM (SELECT count(*) AS n, {_IV_SUMS} FROM c)), "
    "g AS (SELECT *, (s22 * u1 - s12 * u2) / det AS p1, (s11 * u2 - s12 * u1) / det AS p2 FROM s), "
    "f AS (SELECT *, (p1 * v1 + p2 * v2) / (p1 * u1 + p2 * u2) AS b, p1 * u1 + p2 * u2 AS hh FROM g), "
    "e AS (SELECT f.*, (SELECT sum(power((p1 * u + p2 * w) * (y - b * x), 2)) FROM c) AS meat, (SELECT sum(u * u * r * r) FROM (SELECT u, x - p1 * u - p2 * w AS r FROM c)) AS r11, (SELECT sum(u * w * r * r) FROM (SELECT u, w, x - p1 * u - p2 * w AS r FROM c)) AS r12, (SELECT sum(w * w * r * r) FROM (SELECT w, x - p1 * u - p2 * w AS r FROM c)) AS r22 FROM f), "
    "grid AS (SELECT b + (-40.0 + 80.0 * i / 1200.0) * sqrt(meat * n / (n - 2)) / hh AS t, i, * FROM e, (SELECT unnest(range(0, 1201)) AS i)), "
    "st AS (SELECT i, t, n, (a1 * a1 * k22 - 2 * a1 * a2 * k12 + a2 * a2 * k11) / (k11 * k22 - k12 * k12) AS stat FROM (SELECT i, t, n, v1 - t * u1 AS a1, v2 - t * u2 AS a2, yy11 - 2 * t * yd11 + t * t * dd11 AS k11, yy12 - 2 * t * yd12 + t * t * dd12 AS k12, yy22 - 2 * t * yd22 + t * t * dd22 AS k22 FROM grid)), "
    "wald AS (SELECT (p1 * p1 * m22 - 2 * p1 * p2 * m12 + p2 * p2 * m11) / (m11 * m22 - m12 * m12) / 2 * {scale} AS f FROM (SELECT *, (s22 * s22 * r11 - 2 * s12 * s22 * r12 + s12 * s12 * r22) / (det * det) AS m11, (s12 * s12 * r12 + s11 * s22 * r12 - s12 * s22 * r11 - s11 * s12 * r22) / (det * det) AS m12, (s12 * s12 * r11 - 2 * s11 * s12 * r12 + s11 * s11 * r22) / (det * det) AS m22 FROM e)) "
    "SELECT round(min(t), 4) AS low, round(max(t), 4) AS high, NOT (min(i) = 0 OR max(i) = 1200) AS bounded, false AS empty, (SELECT round(f, 4) FROM wald) AS f_statistic, (SELECT f < 10 FROM wald) AS weak FROM st WHERE stat <= {limit}"
).replace("{limit}", repr(5.991464547107979)).replace("{scale}", "(n - 3) / n")

# ---- learners with linear outcome models -----------------------------------------------

_TRIAL = "t AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) / 1000 AS y, CAST(o_custkey % 2 AS DOUBLE) AS d, o_orderkey * 7919 % 1000 / 1000.0 AS a, month(o_orderdate) / 12.0 AS b FROM orders)"
_ARMS = "l AS (SELECT regr_slope(y, a) FILTER (d = 1) AS s1, regr_intercept(y, a) FILTER (d = 1) AS i1, regr_slope(y, a) FILTER (d = 0) AS s0, regr_intercept(y, a) FILTER (d = 0) AS i0 FROM t)"
_CATE = "round(avg(cate), 4) AS mean, round(min(cate), 4) AS low, round(max(cate), 4) AS high"
_FOLDS = "f AS (SELECT k AS fold, regr_slope(y, a) AS sy, regr_intercept(y, a) AS iy, regr_slope(d, a) AS sd, regr_intercept(d, a) AS id_, regr_slope(y, a) FILTER (d = 1) AS s1, regr_intercept(y, a) FILTER (d = 1) AS i1, regr_slope(y, a) FILTER (d = 0) AS s0, regr_intercept(y, a) FILTER (d = 0) AS i0 FROM t, (SELECT unnest([0, 1]) AS k) WHERE id % 2 <> k GROUP BY k), "
_FOLDS += "n AS (SELECT t.*, y - iy - sy * a AS ry, d - least(greatest(id_ + sd * a, 0.02), 0.98) AS rd, least(greatest(id_ + sd * a, 0.02), 0.98) AS p, i1 + s1 * a AS mu1, i0 + s0 * a AS mu0 FROM t JOIN f ON f.fold = t.id % 2)"

ORACLES |= {
    "t_learner": f"WITH {_TRIAL}, {_ARMS} SELECT {_CATE} FROM (SELECT i1 - i0 + (s1 - s0) * a AS cate FROM t, l)",
    "x_learner": f"WITH {_TRIAL}, {_ARMS} SELECT {_CATE} FROM (SELECT i1 - i0 + (s1 - s0) * a AS cate FROM t, l)",
    "s_learner": f"WITH {_TRIAL}, r AS (SELECT y - regr_slope(y, a) OVER () * a AS ry, d - regr_slope(d, a) OVER () * a AS rd FROM t) SELECT round(c, 4) AS mean, round(c, 4) AS low, round(c, 4) AS high FROM (SELECT regr_slope(ry, rd) AS c FROM r)",
    "dml_effect": f"WITH {_TRIAL}, {_FOLDS} SELECT round(th, 4) AS effect, round(sqrt(sum(power(ry - th * rd, 2) * rd * rd)) / sum(rd * rd), 4) AS std_error, count(*) AS n FROM n, (SELECT sum(ry * rd) / sum(rd * rd) AS th FROM n) GROUP BY th",
    "r_learner": f"WITH {_TRIAL}, {_FOLDS}, w AS (SELECT sum(rd * rd) AS w, sum(rd * rd * a) AS wa, sum(rd * rd * a * a) AS waa, sum(rd * ry) AS wt, sum(rd * ry * a) AS wat FROM n) SELECT {_CATE} FROM (SELECT (wt * waa - wat * wa) / (w * waa - wa * wa) + (w * wat - wa * wt) / (w * waa - wa * wa) * a AS cate FROM t, w)",
    "dr_learner": f"WITH {_TRIAL}, {_FOLDS}, g AS (SELECT a, mu1 - mu0 + d * (y - mu1) / p - (1 - d) * (y - mu0) / (1 - p) AS gamma FROM n) SELECT {_CATE} FROM (SELECT i + s * a AS cate FROM t, (SELECT regr_intercept(gamma, a) AS i, regr_slope(gamma, a) AS s FROM g))",
    "plugin_effect": f"WITH {_TRIAL}, m AS (SELECT covar_samp(d, a) AS da, covar_samp(d, b) AS db, covar_samp(a, b) AS ab, var_samp(a) AS aa, var_samp(b) AS bb, var_samp(d) AS dd, covar_samp(y, d) AS yd, covar_samp(y, a) AS ya, covar_samp(y, b) AS yb FROM t) "
    "SELECT round((yd - ya * u - yb * v) / (dd - da * u - db * v), 4) AS effect FROM (SELECT *, (da * bb - db * ab) / (aa * bb - ab * ab) AS u, (db * aa - da * ab) / (aa * bb - ab * ab) AS v FROM m)",
}

# ---- the assignment hash in arithmetic of 64-bit numbers ---------------------------------

_M = 1 << 32


def _scramble(k: str) -> str:
    return f"list_transform(list_transform({k}, lambda x: x * 3432918353 % {_M}), lambda x: ((x << 15) | (x >> 17)) % {_M} * 461845907 % {_M})"


def _murmur(rows: str, key: str) -> str:
    """rows (a SELECT) with the hash ``h`` of the text ``key`` (ASCII)."""
    byte = lambda at: f"CAST(ord(substr(key_, CAST({at} AS BIGINT), 1)) AS UBIGINT)"
    word = f"{byte('4 * i + 1')} + {byte('4 * i + 2')} * 256 + {byte('4 * i + 3')} * 65536 + {byte('4 * i + 4')} * 16777216"
    tail = " + ".join(f"CASE WHEN n_ % 4 > {j} THEN {byte(f'n_ // 4 * 4 + {j + 1}')} * {256**j} ELSE 0 END" for j in range(3))
    mix = f"list_reduce(list_prepend(CAST(0 AS UBIGINT), {_scramble(f'list_transform(range(0, n_ // 4), lambda i: {word})')}), lambda h, k: (((xor(h, k) << 13) | (xor(h, k) >> 19)) % {_M} * 5 + 3864292196) % {_M})"
    steps = f"SELECT *, {mix} AS h0, {_scramble(f'[CAST({tail} AS UBIGINT)]')}[1] AS t_ FROM (SELECT *, CAST(length(key_) AS BIGINT) AS n_ FROM (SELECT *, {key} AS key_ FROM ({rows})))"
    steps = f"SELECT *, xor(xor(h0, t_), CAST(n_ AS UBIGINT)) AS h1 FROM ({steps})"
    steps = f"SELECT *, xor(h1, h1 >> 16) * 2246822507 % {_M} AS h2 FROM ({steps})"
    steps = f"SELECT *, xor(h2, h2 >> 13) * 3266489909 % {_M} AS h3 FROM ({steps})"
    return f"(SELECT * EXCLUDE (key_, n_, h0, t_, h1, h2, h3), CAST(xor(h3, h3 >> 16) AS BIGINT) AS h FROM ({steps}))"


_UNITS = "SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS user_id FROM customer"
_RESPLIT = lambda users, n: f"(SELECT *, CASE WHEN h % 10000 < 5000 THEN 'control' ELSE 'treatment' END AS arm FROM {_murmur(f'SELECT * FROM ({users}), (SELECT printf(' + chr(39) + 's%03d' + chr(39) + f', unnest(range(0, {n}))) AS salt)', 'salt || ' + chr(39) + ':group:' + chr(39) + ' || user_id')})"
_RE = "SELECT DISTINCT user_id FROM dwd"
_REPAIR = (
    "(SELECT t.experiment, t.salt, t.n AS nt, c.n AS nc, t.y AS yt, c.y AS yc, t.v AS vt, c.v AS vc, t.x AS xt, c.x AS xc, t.vx AS vxt, c.vx AS vxc, t.k AS kt, c.k AS kc, th FROM m t JOIN m c ON c.experiment = t.experiment AND c.salt = t.salt AND c.arm = 'control' AND t.arm = 'treatment' "
    "JOIN (SELECT experiment, covar_samp(pre_metric, post_metric) / var_samp(pre_metric) AS th FROM dwd GROUP BY experiment) p ON p.experiment = t.experiment)"
)
_M_CTE = "m AS (SELECT d.experiment, s.salt, s.arm, count(*) AS n, avg(post_metric) AS y, avg(pre_metric) AS x, var_samp(post_metric) AS v, var_samp(pre_metric) AS vx, covar_samp(pre_metric, post_metric) AS k FROM dwd d JOIN {s} s USING (user_id) GROUP BY 1, 2, 3)"


def _resplit_rows(n: int) -> str:
    return (
        f"WITH {CTES}, {_M_CTE.format(s=_RESPLIT(_RE, n))}, r AS (SELECT *, effect / std_error AS t FROM (SELECT experiment, salt, {_PAIR_SUMS.format(a='(vt / nt)', b='(vc / nc)')}, effect - th * (xt - xc) AS adjusted_effect, sqrt(greatest(vt - 2 * th * kt + th * th * vxt, 0) / nt + greatest(vc - 2 * th * kc + th * th * vxc, 0) / nc) AS adjusted_std_error "
        f"FROM (SELECT *, yt - yc AS effect FROM {_REPAIR}))), tested AS (SELECT *, {_t_p('t', 'df')} AS p_value FROM r) "
    )


ORACLES |= {
    "assignment_shares": f"SELECT v AS variant, count(user_id) AS units FROM (SELECT unnest(['control', 'treatment', '__not_enrolled__']) AS v) LEFT JOIN (SELECT user_id, CASE WHEN h / {float(_M)} >= 0.8 THEN '__not_enrolled__' WHEN b < 5000 THEN 'control' ELSE 'treatment' END AS w FROM {_murmur('SELECT user_id, h % 10000 AS b FROM ' + _murmur(_UNITS, chr(39) + 'checkout:group:' + chr(39) + ' || user_id'), chr(39) + 'checkout:traffic:' + chr(39) + ' || user_id')}) ON w = v GROUP BY v",
    "assignment_codes": f"SELECT CAST(CASE WHEN h / {float(_M)} >= 0.9 THEN -1 WHEN b < 5000 THEN 0 WHEN b < 8000 THEN 1 ELSE 2 END AS INTEGER) AS arm_code, count(*) AS units FROM {_murmur('SELECT user_id, h % 10000 AS b FROM ' + _murmur(_UNITS, chr(39) + 'search:group:' + chr(39) + ' || user_id'), chr(39) + 'search:traffic:' + chr(39) + ' || user_id')} GROUP BY 1",
    "layer_routing": f"SELECT CASE WHEN p < 4000 THEN 'a' WHEN p < 7000 THEN 'b' END AS experiment, count(*) AS units FROM (SELECT h % 10000 AS p FROM {_murmur(_UNITS, chr(39) + 'ranking:' + chr(39) + ' || user_id')}) GROUP BY 1",
    "hash_uniformity": f"SELECT salt, units, round(chi2, 4) AS chi2, round({_chi2_p('chi2', '99')}, 6) AS p_value FROM (SELECT salt, CAST(sum(n) AS BIGINT) AS units, sum(n * n) * 100.0 / sum(n) - sum(n) AS chi2 FROM (SELECT salt, h % 10000 // 100 AS cell, count(*) AS n FROM "
    + _murmur(f"SELECT user_id, 'salt' || CAST(i AS VARCHAR) AS salt FROM ({_UNITS}), (SELECT unnest(range(0, 20)) AS i)", "salt || ':group:' || user_id")
    + " GROUP BY 1, 2) GROUP BY salt)",
    "rerandomised_effects": _resplit_rows(20) + f"SELECT experiment, salt, {_r4('effect', 'std_error', 'adjusted_effect', 'adjusted_std_error')}, round(p_value, 6) AS p_value FROM tested",
    "rejection_convergence": _resplit_rows(40) + "SELECT CAST(row_number() OVER w AS INTEGER) AS replicates, round(avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0 END) OVER w, 6) AS rate FROM tested WHERE experiment = 'exp_a' WINDOW w AS (ORDER BY salt)",
    "sample_ratio_replicates": f"WITH {CTES} SELECT salt AS experiment, CAST(a + b AS BIGINT) AS units, round(x, 4) AS chi2, round({_chi2_p('x', '1')}, 6) AS p_value FROM (SELECT *, power(a - b, 2) / (a + b) AS x FROM (SELECT salt, count(*) FILTER (arm = 'control') AS a, count(*) FILTER (arm = 'treatment') AS b FROM {_RESPLIT(_RE + ' WHERE experiment = ' + chr(39) + 'exp_a' + chr(39), 20)} GROUP BY salt))",
}

# ---- monitoring, and the quality gates ---------------------------------------------------


# Bounds of alpha spending, solved by this engine: the density inside the bounds is
# carried from look to look over Simpson's nodes, and each bound is found by Newton's
# steps on the logarithm of the chance beyond it.

_NODES, _TAIL, _STEPS_UP = 160, 200, 10
_INSIDE = "list_sum(list_transform(range(1, len(xs) + 1), lambda j: ms[j] * exp(-0.5 * power(({z} - rho * xs[j]) / s, 2)))) / (s * sqrt(2 * pi()))"
_WEIGHT = "(CASE WHEN {i} = 0 OR {i} = {n} THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END)"


def _inside(z: str) -> str:
    return _INSIDE.format(z=z)


def _solved(rows: str) -> str:
    """Tables ending in bnd(key, look, boundary, spent) for rows(key, look, info)."""
    w = _WEIGHT.format(i="i", n=_TAIL)
    spent = f"2 * list_sum(list_transform(range(0, {_TAIL + 1}), lambda i: {w} * exp(-0.5 * power({Z975} / sqrt(x) + i * 0.04, 2)))) * 0.04 / 3 / sqrt(2 * pi())"
    beyond = f"(2 * list_sum(list_transform(range(0, {_TAIL + 1}), lambda i: {w} * {_inside('(b + i * 0.04)')})) * 0.04 / 3)"
    nodes = f"list_transform(range(0, {_NODES + 1}), lambda i: b * (2.0 * i / {_NODES} - 1))"
    masses = f"list_transform(range(0, {_NODES + 1}), lambda i: {_WEIGHT.format(i='i', n=_NODES)} * b * 2.0 / {_NODES} / 3 * {_inside(f'(b * (2.0 * i / {_NODES} - 1))')})"
    up = f"it < {_STEPS_UP}"
    return (
        f"vec AS (SELECT key, list(info ORDER BY look) AS t, list(look ORDER BY look) AS ls FROM {rows} GROUP BY key), "
        f"plan AS (SELECT t, list_transform(t, lambda x: {spent}) AS sp FROM (SELECT DISTINCT t FROM vec)), "
        "solve AS (SELECT t, sp, 1 AS k, 0 AS it, CAST(2 AS DOUBLE) AS b, [CAST(0 AS DOUBLE)] AS xs, [CAST(1 AS DOUBLE)] AS ms, CAST([] AS DOUBLE[]) AS bs FROM plan UNION ALL "
        f"SELECT t, sp, CASE WHEN {up} THEN k ELSE k + 1 END, CASE WHEN {up} THEN it + 1 ELSE 0 END, CASE WHEN {up} THEN least(8.0, b + tail / (2 * dens) * ln(greatest(tail, 1e-200) / greatest(target, 1e-200))) ELSE 2.0 END, "
        f"CASE WHEN {up} THEN xs ELSE {nodes} END, CASE WHEN {up} THEN ms ELSE {masses} END, CASE WHEN {up} THEN bs ELSE list_append(bs, b) END "
        f"FROM (SELECT *, CASE WHEN {up} THEN {beyond} END AS tail, CASE WHEN {up} THEN {_inside('b')} END AS dens FROM (SELECT *, CASE WHEN k = 1 THEN 0.0 ELSE sqrt(t[k - 1] / t[k]) END AS rho, CASE WHEN k = 1 THEN 1.0 ELSE sqrt(1 - t[k - 1] / t[k]) END AS s, "
        "CASE WHEN k = 1 THEN sp[1] ELSE sp[k] - sp[k - 1] END AS target FROM solve WHERE k <= len(t)))), "
        "bnd AS (SELECT v.key, unnest(v.ls) AS look, unnest(s.bs) AS boundary, unnest(s.sp) AS spent FROM vec v JOIN solve s ON s.t = v.t AND s.k > len(s.t))"
    )


def _recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


ORACLES["sequential_monitor"] = _recursive(
    f"WITH {CTES}, jr AS (SELECT experiment AS key, look, info FROM look), {_solved('jr')} SELECT CAST(look AS INTEGER) AS look, experiment, 'treatment' AS variant, round(info, 6) AS info, round(effect, 4) AS effect, round(se, 4) AS std_error, round(boundary, 4) AS boundary, round(spent, 6) AS spent, round(effect / se, 3) AS z, "
    "abs(effect / se) >= boundary AS crossed, bool_or(abs(effect / se) >= boundary) OVER (PARTITION BY experiment ORDER BY look) AS stopped, round(effect - boundary * se, 2) AS repeated_low, round(effect + boundary * se, 2) AS repeated_high FROM look JOIN (SELECT key AS experiment, look, boundary, spent FROM bnd) USING (experiment, look)"
)

# ---- calibration over splits of exp_a's users ---------------------------------------------

_WILSON = "count(*) AS trials, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS p"
_Z2 = Z975 * Z975
_WILSON_ROW = f"trials, hits, round(p, 4) AS rate, round((p + {_Z2} / (2 * trials)) / (1 + {_Z2} / trials) - {Z975} * sqrt(p * (1 - p) / trials + {_Z2} / (4.0 * trials * trials)) / (1 + {_Z2} / trials), 4) AS low, round((p + {_Z2} / (2 * trials)) / (1 + {_Z2} / trials) + {Z975} * sqrt(p * (1 - p) / trials + {_Z2} / (4.0 * trials * trials)) / (1 + {_Z2} / trials), 4) AS high"
_NEW_SUMS = ("x", "y", "xx", "yy", "xy", "k", "kk", "ky", "y0")
_ADD = "sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, CAST(sum(k) AS DOUBLE) AS k, CAST(sum(k * k) AS DOUBLE) AS kk, sum(k * y) AS ky, sum(y0) AS y0"


def _splits(n: int, lift: float = 0.0, where: str = "") -> str:
    """Tables ending in rr: running sums of every salt, arm and day; pk: its looks."""
    return (
        f"ua AS (SELECT * FROM dwd WHERE experiment = 'exp_a'), rs AS (SELECT salt, arm, expose_ds AS ds, CASE WHEN arm = 'treatment' THEN post_metric * {1 + lift} ELSE post_metric END AS y, pre_metric AS x, post_cnt AS k, post_metric AS y0 FROM ua JOIN {_RESPLIT('SELECT user_id FROM ua', n)} USING (user_id) {where}), "
        f"dd AS (SELECT salt, arm, ds, count(*) AS n, {_ADD} FROM rs GROUP BY 1, 2, 3), "
        "sd AS (SELECT a.salt, a.arm, d.ds FROM (SELECT DISTINCT salt, arm FROM dd) a JOIN (SELECT salt, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM dd GROUP BY salt) d USING (salt)), "
        f"rr AS (SELECT sd.salt, sd.arm, sd.ds, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS n, {', '.join(f'sum(coalesce({c}, 0)) OVER w AS {c}' for c in _NEW_SUMS)} FROM sd LEFT JOIN dd USING (salt, arm, ds) WINDOW w AS (PARTITION BY sd.salt, sd.arm ORDER BY sd.ds)), "
        "fi AS (SELECT salt, ds, sum(n) / max(sum(n)) OVER (PARTITION BY salt) AS info FROM rr GROUP BY salt, ds), "
        "pk AS (SELECT salt, min(ds) AS ds, info, row_number() OVER (PARTITION BY salt ORDER BY info) AS look FROM (SELECT salt, ds, info FROM (SELECT *, row_number() OVER (PARTITION BY salt, k ORDER BY abs(info - k / 5.0), ds) AS r FROM fi, (SELECT unnest(range(1, 6)) AS k)) WHERE r = 1 UNION ALL SELECT salt, max(ds), arg_max(info, ds) FROM fi GROUP BY salt) GROUP BY salt, info)"
    )


def _arm_columns(p: str) -> str:
    cov = lambda a, b, ab: f"({p}.{ab} - {p}.{a} * {p}.{b} / {p}.n) / ({p}.n - 1)"
    names = {"n": f"{p}.n", "my": f"{p}.y / {p}.n", "mx": f"{p}.x / {p}.n", "mk": f"{p}.k / {p}.n", "r": f"{p}.y / nullif({p}.k, 0)", "v": cov("y", "y", "yy"), "vx": cov("x", "x", "xx"), "c": cov("x", "y", "xy"), "vk": cov("k", "k", "kk"), "ck": cov("k", "y", "ky")}
    return ", ".join(f"{v} AS {p}_{k}" for k, v in names.items())


def _tests_of(pairs: str) -> str:
    """est(test, salt, look, info, truth, effect, va, vb, nt, nc) and jr with std_error, df, z and p-value, of arm rows joined as t and c."""
    rv = lambda p: f"greatest({p}_v - 2 * {p}_r * {p}_ck + {p}_r * {p}_r * {p}_vk, 0) / ({p}_n * {p}_mk * {p}_mk)"
    av = lambda p: f"greatest({p}_v - 2 * th * {p}_c + th * th * {p}_vx, 0) / {p}_n"
    return (
        f"pr AS (SELECT t.salt, look, info, {_arm_columns('t')}, {_arm_columns('c')}, t.y0 + c.y0 AS u, t.n + c.n AS un, t.k + c.k AS uk, "
        f"((t.xy + c.xy) - (t.x + c.x) * (t.y + c.y) / (t.n + c.n)) / ((t.xx + c.xx) - (t.x + c.x) * (t.x + c.x) / (t.n + c.n)) AS th FROM {pairs}), "
        "est AS (SELECT 'plain' AS test, salt, look, info, u / un AS per, t_my - c_my AS effect, t_v / t_n AS va, c_v / c_n AS vb, t_n, c_n FROM pr UNION ALL "
        f"SELECT 'adjusted', salt, look, info, u / un, t_my - c_my - th * (t_mx - c_mx), {av('t')}, {av('c')}, t_n, c_n FROM pr UNION ALL SELECT 'ratio', salt, look, info, u / uk, t_r - c_r, {rv('t')}, {rv('c')}, t_n, c_n FROM pr), "
        "tt AS (SELECT *, effect / std_error AS z FROM (SELECT *, sqrt(va + vb) AS std_error, (va + vb) * (va + vb) / (va * va / (t_n - 1) + vb * vb / (c_n - 1)) AS df FROM est WHERE va + vb > 0)), "
        f"jr AS (SELECT test || salt AS key, *, {_t_p('z', 'df')} AS p_value, {_t_quantile(Z975, 'df')} * std_error AS half FROM tt)"
    )


_AT_LOOKS = "pk JOIN rr t ON t.salt = pk.salt AND t.ds = pk.ds AND t.arm = 'treatment' AND t.n > 1 JOIN rr c ON c.salt = pk.salt AND c.ds = pk.ds AND c.arm = 'control' AND c.n > 1"
_BY_LOOK = (
    "SELECT test, CAST(look AS INTEGER) AS look, count(*) AS trials, round(avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0 END), 4) AS rejected, round(avg(CASE WHEN abs(effect - {lift} * per) <= half THEN 1.0 ELSE 0 END), 4) AS covered, round(avg(CASE WHEN stopped THEN 1.0 ELSE 0 END), 4) AS stopped, "
    "round(avg((effect - {lift} * per) / std_error), 3) AS mean_z, round(stddev_samp((effect - {lift} * per) / std_error), 3) AS sd_z FROM (SELECT jr.*, bool_or(abs(z) >= boundary) OVER (PARTITION BY jr.key ORDER BY jr.look) AS stopped FROM jr JOIN bnd ON bnd.key = jr.key AND bnd.look = jr.look) GROUP BY test, look"
)


def _own_tau(alpha: float = 0.05) -> float:
    """tau^2 over the squared error: where r = 2 log(1 / alpha) + log(1 + r), by substitution."""
    import math

    r = 1.0
    for _ in range(200):
        r = 2 * math.log(1 / alpha) + math.log1p(r)
    return r


_R = _own_tau()
_VALID = f"least(1.0, 1 / (sqrt(power(std_error, 2) / (power(std_error, 2) + {_R} * power(last_se, 2))) * exp(effect * effect * {_R} * power(last_se, 2) / (2 * power(std_error, 2) * (power(std_error, 2) + {_R} * power(last_se, 2))))))"
_PLAIN_LOOKS = f"WITH {CTES}, {_splits(100)}, {_tests_of(_AT_LOOKS)}"
_MAX_Z = "(SELECT salt, max(abs(z)) AS m FROM tt WHERE test = 'plain' GROUP BY salt)"

ORACLES |= {
    "aa_calibration": f"WITH {CTES}, {_splits(100)}, {_tests_of('(SELECT salt, 1 AS look, 1.0 AS info, max(ds) AS ds FROM rr GROUP BY salt) pk JOIN rr t ON t.salt = pk.salt AND t.ds = pk.ds AND t.arm = ' + chr(39) + 'treatment' + chr(39) + ' JOIN rr c ON c.salt = pk.salt AND c.ds = pk.ds AND c.arm = ' + chr(39) + 'control' + chr(39))} "
    f"SELECT test, {_WILSON_ROW}, round(mean_z, 4) AS mean_z, round(sd_z, 4) AS sd_z FROM (SELECT test, {_WILSON}, avg(z) AS mean_z, stddev_samp(z) AS sd_z FROM (SELECT *, p_value < 0.05 AS hit FROM jr) GROUP BY test)",
    "calibration_by_look": _recursive(f"WITH {CTES}, {_splits(60)}, {_tests_of(_AT_LOOKS)}, {_solved('jr')} {_BY_LOOK.format(lift=0)}"),
    "power_by_look": _recursive(f"WITH {CTES}, {_splits(60, 0.3)}, {_tests_of(_AT_LOOKS)}, {_solved('jr')} {_BY_LOOK.format(lift=0.3)}"),
    "stopping_rules": _recursive(
        f"{_PLAIN_LOOKS}, pl AS (SELECT *, last_value(std_error) OVER (PARTITION BY key ORDER BY look ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_se FROM jr WHERE test = 'plain'), {_solved('pl')}, "
        f"per AS (SELECT pl.key, max(abs(z)) > {Z975} AS naive, arg_max(abs(z), pl.look) > {Z975} AS fixed, bool_or(abs(z) >= boundary) AS sequential, min({_VALID}) <= 0.05 AS always_valid FROM pl JOIN bnd ON bnd.key = pl.key AND bnd.look = pl.look GROUP BY pl.key) "
        f"SELECT rule, {_WILSON_ROW} FROM (SELECT rule, {_WILSON} FROM (SELECT unnest(['naive', 'fixed', 'sequential', 'always_valid']) AS rule, unnest([naive, fixed, sequential, always_valid]) AS hit FROM per) GROUP BY rule)"
    ),
    "constant_boundary": f"{_PLAIN_LOOKS} SELECT round(b, 4) AS boundary, count(*) AS trials, round(avg(CASE WHEN m > b THEN 1.0 ELSE 0 END), 4) AS stopped, round(avg(CASE WHEN m > {Z975} THEN 1.0 ELSE 0 END), 4) AS naive FROM {_MAX_Z}, (SELECT quantile_cont(m, 0.95) AS b FROM {_MAX_Z} WHERE salt < 's050') WHERE salt >= 's050' GROUP BY b",
    "cluster_calibration": f"WITH {CTES}, cu AS (SELECT * FROM dwd WHERE experiment = 'exp_city' AND city IS NOT NULL), cs AS (SELECT salt, arm, user_id AS city FROM {_RESPLIT('SELECT DISTINCT city AS user_id FROM cu', 60)}), "
    "cc AS (SELECT salt, arm, city, count(*) AS n, sum(post_metric) AS y, sum(post_metric * post_metric) AS yy FROM cu JOIN cs USING (city) GROUP BY 1, 2, 3), "
    "ca AS (SELECT 'user' AS unit, salt, arm, CAST(sum(n) AS DOUBLE) AS n, sum(y) / sum(n) AS m, (sum(yy) - sum(y) * sum(y) / sum(n)) / (sum(n) - 1) AS v FROM cc GROUP BY 1, 2, 3 UNION ALL SELECT 'cluster', salt, arm, count(*), avg(y / n), var_samp(y / n) FROM cc GROUP BY 1, 2, 3), "
    "ct AS (SELECT t.unit, (t.m - c.m) / sqrt(t.v / t.n + c.v / c.n) AS z, power(t.v / t.n + c.v / c.n, 2) / (power(t.v / t.n, 2) / (t.n - 1) + power(c.v / c.n, 2) / (c.n - 1)) AS df FROM ca t JOIN ca c ON c.unit = t.unit AND c.salt = t.salt AND t.arm = 'treatment' AND c.arm = 'control' WHERE t.n > 1 AND c.n > 1) "
    f"SELECT unit, {_WILSON_ROW} FROM (SELECT unit, {_WILSON} FROM (SELECT unit, {_t_p('z', 'df')} < 0.05 AS hit FROM ct) GROUP BY unit)",
    "share_dispersion": f"WITH {CTES} SELECT splits, round(mean_z, 4) AS mean_z, round(sd_z, 4) AS sd_z, round(chi2, 4) AS chi2, round({_chi2_p('chi2', 'CAST(splits AS DOUBLE)')}, 6) AS over_p, round(1 - {_chi2_p('chi2', 'CAST(splits AS DOUBLE)')}, 6) AS under_p FROM (SELECT count(*) AS splits, avg(z) AS mean_z, stddev_samp(z) AS sd_z, sum(z * z) AS chi2 FROM "
    f"(SELECT (t - n * 0.5) / sqrt(n * 0.25) AS z FROM (SELECT salt, count(*) AS n, count(*) FILTER (arm = 'treatment') AS t FROM {_RESPLIT(_RE + ' WHERE experiment = ' + chr(39) + 'exp_a' + chr(39), 40)} GROUP BY salt)))",
    "layer_orthogonality": "WITH h AS (SELECT user_id, salt, h % 10000 >= 5000 AS two FROM " + _murmur(f"SELECT user_id, 'layer' || CAST(i AS VARCHAR) AS salt FROM ({_UNITS}), (SELECT unnest(range(0, 8)) AS i)", "salt || ':group:' || user_id") + "), "
    "p AS (SELECT a.salt AS left_salt, b.salt AS right_salt, count(*) AS units, count(*) FILTER (a.two AND b.two) AS b2, count(*) FILTER (a.two) AS left_n, count(*) FILTER (b.two) AS right_n FROM h a JOIN h b ON a.user_id = b.user_id AND a.salt < b.salt GROUP BY 1, 2) "
    f"SELECT left_salt, right_salt, units, b2 AS \"both\", left_n, right_n, round(chi2, 4) AS chi2, round({_chi2_p('chi2', '1')}, 6) AS p_value FROM (SELECT *, units * power(CAST(units AS DOUBLE) * b2 - CAST(left_n AS DOUBLE) * right_n, 2) / (CAST(left_n AS DOUBLE) * right_n * (units - left_n) * (units - right_n)) AS chi2 FROM p)",
}
# ---- looks by the declared unit ------------------------------------------------------------

_CLUSTER_CTES = (
    ", crun AS (SELECT * FROM (SELECT k.experiment, k.variant, k.cluster_id, d.ds, CAST(sum(coalesce(user_cnt, 0)) OVER w AS DOUBLE) AS n, sum(coalesce(pre_sum, 0)) OVER w AS x, sum(coalesce(post_sum, 0)) OVER w AS y, sum(coalesce(post_sq_sum, 0)) OVER w AS yy FROM (SELECT DISTINCT experiment, variant, cluster_id FROM cluster_daily) k "
    "JOIN (SELECT experiment, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM cluster_daily GROUP BY experiment) d USING (experiment) LEFT JOIN cluster_daily c ON c.experiment = k.experiment AND c.variant = k.variant AND c.cluster_id = k.cluster_id AND c.ds = d.ds WINDOW w AS (PARTITION BY k.experiment, k.variant, k.cluster_id ORDER BY d.ds)) WHERE n > 0), "
    "cinfo AS (SELECT experiment, ds, c / max(c) OVER (PARTITION BY experiment) AS info FROM (SELECT experiment, ds, sum(c) AS c, min(c) AS least, count(*) AS arms FROM (SELECT experiment, variant, ds, count(*) AS c FROM crun GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE least >= 2 AND arms >= 2), "
    "cpick AS (SELECT experiment, min(ds) AS ds, info, row_number() OVER (PARTITION BY experiment ORDER BY info) AS look FROM (SELECT experiment, ds, info FROM (SELECT *, row_number() OVER (PARTITION BY experiment, k ORDER BY abs(info - k / 3.0), ds) AS r FROM cinfo, (SELECT unnest(range(1, 4)) AS k)) WHERE r = 1 UNION ALL SELECT experiment, max(ds), arg_max(info, ds) FROM cinfo GROUP BY experiment) GROUP BY experiment, info), "
    "cm AS (SELECT r.experiment, r.variant, p.look, p.info, count(*) AS g, avg(y / n) AS my, avg(x / n) AS mx, var_samp(y / n) AS vy, var_samp(x / n) AS vx, covar_samp(x / n, y / n) AS k, sum(y / n) AS sy, sum(x / n) AS sx, sum(x / n * x / n) AS sxx, sum(x / n * y / n) AS sxy, sum(n) AS un, sum(y) AS uy, sum(yy) AS uyy FROM crun r JOIN cpick p ON p.experiment = r.experiment AND p.ds = r.ds GROUP BY 1, 2, 3, 4), "
    "cp AS (SELECT t.experiment, t.look, t.info, t.g AS tg, c.g AS cg, t.my AS ty, c.my AS cy, t.mx AS tx, c.mx AS cx, t.vy AS tvy, c.vy AS cvy, t.vx AS tvx, c.vx AS cvx, t.k AS tk, c.k AS ck, ((t.sxy + c.sxy) - (t.sx + c.sx) * (t.sy + c.sy) / (t.g + c.g)) / ((t.sxx + c.sxx) - power(t.sx + c.sx, 2) / (t.g + c.g)) AS th, "
    "t.uy / t.un - c.uy / c.un AS ue, sqrt((t.uyy - t.uy * t.uy / t.un) / (t.un - 1) / t.un + (c.uyy - c.uy * c.uy / c.un) / (c.un - 1) / c.un) AS us FROM cm t JOIN cm c ON c.experiment = t.experiment AND c.look = t.look AND t.variant = 'treatment' AND c.variant = 'control'), "
    "cl AS (SELECT 'cluster_level' AS estimator, experiment, look, info, ty - cy AS effect, sqrt(tvy / tg + cvy / cg) AS se FROM cp UNION ALL SELECT 'cluster_cuped', experiment, look, info, ty - cy - th * (tx - cx), sqrt(greatest(tvy - 2 * th * tk + th * th * tvx, 0) / tg + greatest(cvy - 2 * th * ck + th * th * cvx, 0) / cg) FROM cp UNION ALL SELECT 'unit_level', experiment, look, info, ue, us FROM cp)"
)
_THREE = (
    ", near3 AS (SELECT experiment, ds, info, row_number() OVER (PARTITION BY experiment, k ORDER BY abs(info - k / 3.0), ds) AS r FROM info, (SELECT unnest(range(1, 4)) AS k)), pick3 AS (SELECT experiment, min(ds) AS ds, info, row_number() OVER (PARTITION BY experiment ORDER BY info) AS look FROM (SELECT experiment, ds, info FROM near3 WHERE r = 1 UNION ALL SELECT experiment, max(ds), arg_max(info, ds) FROM info GROUP BY experiment) GROUP BY experiment, info), "
    "ul AS (SELECT p.experiment, p.look, p.info, t.n AS tn, c.n AS cn, t.sum_y / t.n - c.sum_y / c.n AS gap, t.sum_x / t.n - c.sum_x / c.n AS pre, (t.sum_yy - t.sum_y * t.sum_y / t.n) / (t.n - 1) AS tv, (c.sum_yy - c.sum_y * c.sum_y / c.n) / (c.n - 1) AS cv, (t.sum_xx - t.sum_x * t.sum_x / t.n) / (t.n - 1) AS tvx, (c.sum_xx - c.sum_x * c.sum_x / c.n) / (c.n - 1) AS cvx, "
    "(t.sum_xy - t.sum_x * t.sum_y / t.n) / (t.n - 1) AS tk, (c.sum_xy - c.sum_x * c.sum_y / c.n) / (c.n - 1) AS ck, ((t.sum_xy + c.sum_xy) - (t.sum_x + c.sum_x) * (t.sum_y + c.sum_y) / (t.n + c.n)) / ((t.sum_xx + c.sum_xx) - power(t.sum_x + c.sum_x, 2) / (t.n + c.n)) AS th "
    "FROM pick3 p JOIN run t ON t.experiment = p.experiment AND t.ds = p.ds AND t.variant = 'treatment' JOIN run c ON c.experiment = p.experiment AND c.ds = p.ds AND c.variant = 'control' WHERE t.n > 1 AND c.n > 1), "
    "jr AS (SELECT experiment AS key, look, info, 'cuped' AS path, gap - th * pre AS effect, sqrt(greatest(tv - 2 * th * tk + th * th * tvx, 0) / tn + greatest(cv - 2 * th * ck + th * th * cvx, 0) / cn) AS std_error, 'post_only' AS beside, gap AS beside_effect, sqrt(tv / tn + cv / cn) AS beside_std_error FROM ul WHERE experiment = 'exp_a' UNION ALL "
    "SELECT a.experiment, a.look, a.info, a.estimator, a.effect, a.se, b.estimator, b.effect, b.se FROM cl a JOIN cl b ON b.experiment = a.experiment AND b.look = a.look AND a.estimator = 'cluster_cuped' AND b.estimator = 'cluster_level' WHERE a.experiment = 'exp_city')"
)
ORACLES |= {
    "ratio_looks": sql(
        "SELECT p.experiment, 'treatment' AS variant, CAST(p.look AS INTEGER) AS look, round(p.info, 6) AS info, round(t.y / t.x - c.y / c.x, 4) AS effect, round(sqrt(" + _RV("t") + " + " + _RV("c") + "), 4) AS std_error FROM picks p JOIN rrun t ON t.experiment = p.experiment AND t.ds = p.ds AND t.variant = 'treatment' JOIN rrun c ON c.experiment = p.experiment AND c.ds = p.ds AND c.variant = 'control' WHERE t.n > 1 AND c.n > 1"
    ).replace(" SELECT p.experiment", ", rrun AS (SELECT s.experiment, s.variant, s.ds, CAST(sum(coalesce(user_cnt, 0)) OVER w AS DOUBLE) AS n, sum(coalesce(sum_y, 0)) OVER w AS y, CAST(sum(coalesce(sum_x, 0)) OVER w AS DOUBLE) AS x, sum(coalesce(sum_yy, 0)) OVER w AS yy, CAST(sum(coalesce(sum_xx, 0)) OVER w AS DOUBLE) AS xx, sum(coalesce(sum_xy, 0)) OVER w AS xy FROM spine s LEFT JOIN ratio_daily USING (experiment, variant, ds) WINDOW w AS (PARTITION BY s.experiment, s.variant ORDER BY s.ds)) SELECT p.experiment", 1),
    "cluster_effects_by_look": f"WITH {CTES}{_CLUSTER_CTES} SELECT estimator, experiment, 'treatment' AS variant, CAST(look AS INTEGER) AS look, round(info, 6) AS info, round(effect, 4) AS effect, round(se, 4) AS std_error FROM cl",
    "monitoring": _recursive(
        f"WITH {CTES}{_CLUSTER_CTES}{_THREE}, pl AS (SELECT *, effect / std_error AS z, last_value(std_error) OVER (PARTITION BY key ORDER BY look ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_se FROM jr), {_solved('pl')} "
        f"SELECT pl.key AS experiment, 'treatment' AS variant, CAST(pl.look AS INTEGER) AS look, round(info, 6) AS info, path, round(boundary, 4) AS boundary, {', '.join(f'round({c}, 3) AS {c}' for c in ('effect', 'std_error', 'beside_effect', 'beside_std_error'))}, round(z, 3) AS z, abs(z) >= boundary AS crossed, bool_or(abs(z) >= boundary) OVER w AS stopped, round(effect - boundary * std_error, 2) AS repeated_low, "
        f"round(effect + boundary * std_error, 2) AS repeated_high, round(last_se * sqrt({_R}), 3) AS tau, round(min({_VALID}) OVER w, 5) AS always_valid_p, beside FROM pl JOIN bnd ON bnd.key = pl.key AND bnd.look = pl.look WINDOW w AS (PARTITION BY pl.key ORDER BY pl.look)"
    ),
}
_CITY_SPLITS = (
    f"cu AS (SELECT * FROM dwd WHERE experiment = 'exp_city' AND city IS NOT NULL), cs AS (SELECT salt, arm, user_id AS city FROM {_RESPLIT('SELECT DISTINCT city AS user_id FROM cu', 30)}), "
    "cd2 AS (SELECT salt AS experiment, arm AS variant, city AS cluster_id, expose_ds AS ds, count(*) AS user_cnt, sum(pre_metric) AS pre_sum, sum(post_metric) AS post_sum, sum(post_metric * post_metric) AS post_sq_sum FROM cu JOIN cs USING (city) GROUP BY 1, 2, 3, 4)"
)
ORACLES["cluster_calibration_by_look"] = _recursive(
    f"WITH {CTES}, {_CITY_SPLITS}{_CLUSTER_CTES.replace('cluster_daily', 'cd2')}, pl AS (SELECT estimator || experiment AS key, * FROM cl WHERE se > 0), {_solved('pl')} "
    f"SELECT estimator, CAST(look AS INTEGER) AS look, count(*) AS trials, round(avg(CASE WHEN abs(effect / se) > {Z975} THEN 1.0 ELSE 0 END), 4) AS rejected, round(avg(CASE WHEN stopped THEN 1.0 ELSE 0 END), 4) AS stopped, round(avg(effect / se), 3) AS mean_z, round(stddev_samp(effect / se), 3) AS sd_z FROM "
    "(SELECT pl.*, bool_or(abs(effect / se) >= boundary) OVER (PARTITION BY pl.key ORDER BY pl.look) AS stopped FROM pl JOIN bnd ON bnd.key = pl.key AND bnd.look = pl.look) GROUP BY estimator, look"
)
_OWN_PATH = "(SELECT *, se AS std_error, last_value(se) OVER (PARTITION BY experiment ORDER BY look ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_se FROM look)"
ORACLES["experiment_report"] = ORACLES["experiment_report"].replace(f"(SELECT experiment, min(p) AS p FROM {_PATH} GROUP BY experiment)", f"(SELECT experiment, min({_VALID}) AS p FROM {_OWN_PATH} GROUP BY experiment)")


#: What each checked table is in the common table expressions above.
_CHECKED = {
    "dwd_experiment_user": "dwd",
    "dws_experiment_variant_daily": "dws",
    "ads_experiment_result": "ads",
    "ads_experiment_srm": "(SELECT *, power(user_cnt - expected_cnt, 2) / nullif(expected_cnt, 0) AS chi2_component FROM srm0)",
    "dws_experiment_cluster_daily": "cluster_daily",
    "dws_experiment_ratio_daily": "ratio_daily",
    "ads_experiment_ratio_result": "(SELECT experiment, variant, n AS user_cnt, yy AS sum_yy, xx AS sum_xx FROM ratio)",
    "dws_experiment_guardrail_daily": "guard_daily",
    "ads_experiment_guardrail_result": "(SELECT experiment, guardrail, variant, n AS user_cnt, yy AS value_sq_sum FROM guard)",
    "dws_experiment_covariate_daily": "cov_daily",
    "ads_experiment_covariate_result": "(SELECT experiment, variant, n AS user_cnt, mm AS pre_metric_sq_sum, kk AS pre_cnt_sq_sum FROM cov)",
    "guardrail_config": "dim_guardrail_config",
}


def _quality() -> str:
    from veltrial.schemas import CONTRACTS

    parts = []
    for name, source in _CHECKED.items():
        c = CONTRACTS[name]
        checks = [(f"null_key:{k}", f"{k} IS NULL") for k in c.key] + [(f"null:{k}", f"{k} IS NULL") for k in c.required]
        checks += [(f"enum:{k}", f"{k} IS NULL OR {k} NOT IN ({', '.join(map(repr, v))})") for k, v in c.enums.items()] + [(f"negative:{k}", f"{k} < 0") for k in c.non_negative]
        parts += [f"SELECT '{name}' AS \"table\", '{label}' AS \"check\", count(*) FILTER ({bad}) AS bad FROM {source}" for label, bad in checks]
        parts.append(f"SELECT '{name}', 'duplicate_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(c.key)})")
    return sql(" UNION ALL ".join(parts))


ORACLES["quality_checks"] = _quality()
ORACLES["late_arm_problems"] = (
    f"WITH {CTES.replace('FROM dwd GROUP BY 1, 2, 3),' + chr(10) + 'ads AS', 'FROM dwd WHERE variant = ' + chr(39) + 'control' + chr(39) + ' OR day(expose_ds) >= 20 GROUP BY 1, 2, 3),' + chr(10) + 'ads AS')} "
    "SELECT DISTINCT experiment, 'an arm has fewer than two units' AS problem FROM picks JOIN run USING (experiment, ds) WHERE n < 2 "
    "UNION SELECT DISTINCT experiment, 'an arm is missing from a look' FROM (SELECT experiment, ds FROM picks JOIN run USING (experiment, ds) GROUP BY experiment, ds HAVING count(DISTINCT variant) < 2)"
)

_AREA = lambda order: (
    f"(SELECT sum((f - pf) * (q + pq) / 2) AS a FROM (SELECT f, q, lag(f) OVER (ORDER BY f) AS pf, lag(q) OVER (ORDER BY f) AS pq FROM (SELECT rk / total AS f, q FROM (SELECT rk, total, sum(y * d) OVER w - CASE WHEN sum(1 - d) OVER w > 0 THEN sum(y * (1 - d)) OVER w * sum(d) OVER w / sum(1 - d) OVER w ELSE 0 END AS q "
    f"FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rk, count(*) OVER () AS total FROM scored) WINDOW w AS (ORDER BY rk)) JOIN points USING (rk))))"
)
ORACLES["score_ceiling"] = sql(f"SELECT 'perfect' AS score, round(a, 1) AS auuc FROM {_AREA('y DESC, id')} UNION ALL SELECT 'flat', round(a, 1) FROM {_AREA('id')}")

# ---- ranks by key, wild bootstrap, comparison, heterogeneity -------------------------------

_DRAW = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
_WEBB = "[-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)]"
_CR1 = "sqrt((ss1 / (n1 * n1) + ss0 / (n0 * n0)) * g / (g - 1) * (n1 + n0 - 1) / (n1 + n0 - 2))"


def _half_warehouse(k: int) -> str:
    """The tables above over the events of users with even (0) or odd (1) numbers."""
    return CTES.replace("FROM events", f"FROM (SELECT * FROM events WHERE user_id % 2 = {k}) events")


_DAY_Z = "SELECT t.experiment, t.variant, t.ds, t.sum_y / t.n - c.sum_y / c.n AS e, sqrt((t.sum_yy - t.sum_y * t.sum_y / t.n) / (t.n - 1) / t.n + (c.sum_yy - c.sum_y * c.sum_y / c.n) / (c.n - 1) / c.n) AS s FROM run t JOIN run c ON c.experiment = t.experiment AND c.ds = t.ds AND c.variant = 'control' AND t.variant <> 'control' WHERE t.n > 1 AND c.n > 1 AND t.experiment = 'exp_a'"
_SHAPE = "SELECT {name} AS warehouse, count(*) AS n, avg(post_metric) AS mean, stddev_samp(post_metric) AS sd, avg(CASE WHEN post_metric = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, max(post_metric) / avg(post_metric) AS max_over_mean FROM dwd"


def _of_half(k: int, body: str) -> str:
    return f"(WITH {_half_warehouse(k)} {body})"


_SPLIT_ROWS = (
    f"WITH {_TRIAL}, each AS (SELECT t.*, s AS split, {_DRAW(chr(39) + '0:' + chr(39) + ' || s || ' + chr(39) + ':' + chr(39) + ' || id')} % 2 AS half FROM t, (SELECT unnest(range(0, 10)) AS s)), "
    "fit AS (SELECT split, regr_slope(y, a) FILTER (d = 1) AS s1, regr_intercept(y, a) FILTER (d = 1) AS i1, regr_slope(y, a) FILTER (d = 0) AS s0, regr_intercept(y, a) FILTER (d = 0) AS i0 FROM each WHERE half = 0 GROUP BY split), "
    "sc AS (SELECT split, i1 + s1 * a - i0 - s0 * a AS proxy, i1 + s1 * a - i0 - s0 * a + d * (y - i1 - s1 * a) / 0.5 - (1 - d) * (y - i0 - s0 * a) / 0.5 AS score FROM each JOIN fit USING (split) WHERE half = 1) "
)
_Z9875 = 2.241402727604947  # two medians of bounds, each at half of alpha
_MEDIANS = lambda v, e: f"count(*) AS splits, round(median({v}), 3) AS estimate, round(median({v} - {_Z9875} * {e}), 3) AS low, round(median({v} + {_Z9875} * {e}), 3) AS high"
_BLP = (
    _SPLIT_ROWS + ", st AS (SELECT split, count(*) AS n, avg(proxy) AS mt, avg(score) AS effect, covar_samp(proxy, score) / var_samp(proxy) AS slope, var_samp(proxy) * (count(*) - 1) AS tt FROM sc GROUP BY split), "
    "bl AS (SELECT split, effect, slope, sqrt(sum(e * e)) / n * sqrt(n / (n - 2)) AS effect_se, sqrt(sum(t * t * e * e)) / tt * sqrt(n / (n - 2)) AS slope_se FROM (SELECT *, proxy - mt AS t, score - effect - slope * (proxy - mt) AS e FROM sc JOIN st USING (split)) GROUP BY split, effect, slope, n, tt) "
)
_SIDES = "sum(CASE WHEN d = 1 THEN 1.0 ELSE 0 END) AS n1, sum(CASE WHEN d = 1 THEN y ELSE 0 END) AS y1, sum(CASE WHEN d = 0 THEN 1.0 ELSE 0 END) AS n0, sum(CASE WHEN d = 0 THEN y ELSE 0 END) AS y0"
_UPTO = ", ".join(f"sum({s}) OVER (PARTITION BY tree, feature ORDER BY bin) AS l{s}, sum({s}) OVER (PARTITION BY tree, feature) AS a{s}" for s in ("n1", "y1", "n0", "y0"))

ORACLES |= {
    "nested_prefixes": f"WITH {CTES}, o AS (SELECT *, ntile(4) OVER (PARTITION BY experiment, variant ORDER BY h, user_id) AS look FROM {_murmur('SELECT * FROM dwd', chr(39) + 'order:' + chr(39) + ' || user_id')}) "
    "SELECT experiment, variant, CAST(look AS INTEGER) AS look, CAST(sum(n) OVER w AS BIGINT) AS n, round(sum(x) OVER w, 4) AS sum_x, round(sum(y) OVER w, 4) AS sum_y, round(sum(xx) OVER w, 4) AS sum_xx, round(sum(yy) OVER w, 4) AS sum_yy, round(sum(xy) OVER w, 4) AS sum_xy FROM "
    "(SELECT experiment, variant, look, count(*) AS n, sum(pre_metric) AS x, sum(post_metric) AS y, sum(pre_metric * pre_metric) AS xx, sum(post_metric * post_metric) AS yy, sum(pre_metric * post_metric) AS xy FROM o GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY experiment, variant ORDER BY look)",
    "line_quantiles": "SELECT l_returnflag, l_linestatus, count(*) AS n, q, round(CASE q WHEN 0.1 THEN quantile_cont(v, 0.1) WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.9) END, 4) AS quantile FROM (SELECT *, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem), (SELECT unnest([CAST(0.1 AS DOUBLE), 0.5, 0.9]) AS q) GROUP BY l_returnflag, l_linestatus, q",
    "wild_bootstrap": f"WITH {CTES}, wc AS (SELECT experiment, cluster_id, n, y, variant <> 'control' AS t FROM clus WHERE experiment NOT IN (SELECT experiment FROM clus GROUP BY experiment, cluster_id HAVING count(DISTINCT variant) > 1)), "
    f"wf AS (SELECT *, y1 / n1 - y0 / n0 AS effect, {_CR1} AS se FROM (SELECT experiment, count(*) AS g, any_value(n1) AS n1, any_value(n0) AS n0, any_value(y1) AS y1, any_value(y0) AS y0, sum(CASE WHEN t THEN power(y - n * y1 / n1, 2) ELSE 0 END) AS ss1, sum(CASE WHEN t THEN 0 ELSE power(y - n * y0 / n0, 2) END) AS ss0 FROM "
    "(SELECT *, sum(CASE WHEN t THEN n END) OVER w AS n1, sum(CASE WHEN t THEN 0 ELSE n END) OVER w AS n0, sum(CASE WHEN t THEN y END) OVER w AS y1, sum(CASE WHEN t THEN 0 ELSE y END) OVER w AS y0 FROM wc WINDOW w AS (PARTITION BY experiment)) GROUP BY experiment)), "
    f"wd AS (SELECT experiment, r, t, n, f.n1, f.n0, f.g, n * (y1 + y0) / (n1 + n0) + list_extract({_WEBB}, {_DRAW(chr(39) + '7:' + chr(39) + ' || r || ' + chr(39) + ':' + chr(39) + ' || cluster_id')} % 6 + 1) * (y - n * (y1 + y0) / (n1 + n0)) AS v FROM wc JOIN wf f USING (experiment), (SELECT unnest(range(0, 999)) AS r)), "
    f"wr AS (SELECT experiment, r, abs((m1 - m0) / {_CR1}) AS z FROM (SELECT experiment, r, n1, n0, g, any_value(m1) AS m1, any_value(m0) AS m0, sum(CASE WHEN t THEN power(v - n * m1, 2) ELSE 0 END) AS ss1, sum(CASE WHEN t THEN 0 ELSE power(v - n * m0, 2) END) AS ss0 FROM "
    "(SELECT *, sum(CASE WHEN t THEN v END) OVER w / n1 AS m1, sum(CASE WHEN t THEN 0 ELSE v END) OVER w / n0 AS m0 FROM wd WINDOW w AS (PARTITION BY experiment, r)) GROUP BY experiment, r, n1, n0, g)) "
    "SELECT experiment, round(effect, 4) AS effect, round(se, 4) AS std_error, round((1 + (SELECT count(*) FROM wr WHERE wr.experiment = wf.experiment AND z >= abs(effect / se))) / 1000.0, 4) AS p_value, round(0.001, 4) AS p_resolution, g AS clusters FROM wf",
    "value_distance": sql(
        "SELECT n_left, n_right, round(d, 8) AS distance, round(place, 4) AS \"at\", round(CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: 2 * power(-1, k - 1) * exp(-2 * k * k * x * x))))) END, 6) AS p_value FROM (SELECT *, sqrt(n_left * n_right / (n_left + n_right)) * d AS x FROM "
        "(SELECT CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right, max(gap) AS d, arg_max(v, round(gap, 12)) AS place FROM (SELECT v, nl, nr, abs(sum(l) OVER w / nl - sum(r) OVER w / nr) AS gap FROM (SELECT v, sum(l) AS l, sum(r) AS r, sum(sum(l)) OVER () AS nl, sum(sum(r)) OVER () AS nr FROM "
        "(SELECT metric_value AS v, CASE WHEN day(ds) <= 15 THEN 1 ELSE 0 END AS l, CASE WHEN day(ds) <= 15 THEN 0 ELSE 1 END AS r FROM ods_event_log WHERE event_name = 'purchase' AND metric_value IS NOT NULL) GROUP BY v) WINDOW w AS (ORDER BY v) ORDER BY v) GROUP BY nl, nr))"
    ),
    "warehouse_shapes": " UNION ALL ".join(f"SELECT warehouse, n, {_r4('mean', 'sd', 'max_over_mean')}, round(zero_share, 6) AS zero_share FROM {_of_half(k, _SHAPE.format(name=repr(name)))}" for k, name in enumerate(("even", "odd"))),
    "warehouse_days": f"SELECT experiment, variant, CAST(day AS INTEGER) AS day, round(le, 4) AS left_effect, round(ls, 4) AS left_std_error, round(le / ls, 3) AS left_z, round(re, 4) AS right_effect, round(rs, 4) AS right_std_error, round(re / rs, 3) AS right_z, round(gap, 3) AS gap_z, round({_two_sided('gap')}, 4) AS gap_p FROM "
    "(SELECT *, (le - re) / sqrt(ls * ls + rs * rs) AS gap FROM (SELECT experiment, variant, date_diff('day', min(ds) OVER (PARTITION BY experiment, variant), ds) + 1 AS day, e AS le, s AS ls FROM "
    f"{_of_half(0, _DAY_Z)}) FULL JOIN (SELECT experiment, variant, date_diff('day', min(ds) OVER (PARTITION BY experiment, variant), ds) + 1 AS day, e AS re, s AS rs FROM {_of_half(1, _DAY_Z)}) USING (experiment, variant, day))",
    "linear_predictor": f"{_BLP} SELECT 'effect' AS term, {_MEDIANS('effect', 'effect_se')} FROM bl UNION ALL SELECT 'slope', {_MEDIANS('slope', 'slope_se')} FROM bl",
    "sorted_effects": f"{_SPLIT_ROWS}, cut AS (SELECT split, quantile_cont(proxy, [0.25, 0.5, 0.75]) AS q FROM sc GROUP BY split), gr AS (SELECT split, 1 + CAST(proxy > q[1] AS INTEGER) + CAST(proxy > q[2] AS INTEGER) + CAST(proxy > q[3] AS INTEGER) AS g, avg(score) AS effect, stddev_samp(score) / sqrt(count(*)) AS se FROM sc JOIN cut USING (split) GROUP BY 1, 2) "
    f"SELECT CAST(g AS INTEGER) AS \"group\", {_MEDIANS('effect', 'se')} FROM gr GROUP BY g",
    "forest_first_level": f"WITH {_TRIAL}, tr AS (SELECT t.*, tree, {_DRAW(chr(39) + '0:bag:' + chr(39) + ' || tree // 2 || ' + chr(39) + ':' + chr(39) + ' || id')} % 2 AS outside, {_DRAW(chr(39) + '0:tree:' + chr(39) + ' || tree || ' + chr(39) + ':' + chr(39) + ' || id')} % 2 AS half FROM t, (SELECT unnest(range(0, 8)) AS tree)), "
    "bn AS (SELECT *, unnest(['a', 'b']) AS feature, unnest([list_sum(list_transform(range(1, 16), lambda k: CASE WHEN a > k / 16.0 THEN 1 ELSE 0 END)), list_sum(list_transform(range(1, 12), lambda k: CASE WHEN b > k / CAST(12 AS DOUBLE) THEN 1 ELSE 0 END))]) AS bin FROM tr WHERE outside = 0), "
    f"hs AS (SELECT tree, feature, bin, {_SIDES} FROM bn WHERE half = 0 GROUP BY 1, 2, 3), up AS (SELECT tree, feature, bin, {_UPTO} FROM hs), "
    "gn AS (SELECT *, (ln1 + ln0) * power(ly1 / ln1 - ly0 / ln0, 2) + (an1 - ln1 + an0 - ln0) * power((ay1 - ly1) / (an1 - ln1) - (ay0 - ly0) / (an0 - ln0), 2) - (an1 + an0) * power(ay1 / an1 - ay0 / an0, 2) AS gain FROM up WHERE least(ln1, ln0, an1 - ln1, an0 - ln0) >= 20), "
    "bs AS (SELECT tree, feature, bin, gain FROM gn WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY tree ORDER BY round(gain, 6) DESC, feature, bin) = 1) "
    "SELECT CAST(bs.tree AS INTEGER) AS tree, CAST(1 AS INTEGER) AS node, bs.feature, CAST(bs.bin AS INTEGER) AS bin, round(gain, 2) AS gain, round(avg(y) FILTER (bn.bin <= bs.bin AND d = 1) - avg(y) FILTER (bn.bin <= bs.bin AND d = 0), 4) AS left_effect, round(avg(y) FILTER (bn.bin > bs.bin AND d = 1) - avg(y) FILTER (bn.bin > bs.bin AND d = 0), 4) AS right_effect "
    "FROM bs JOIN bn ON bn.tree = bs.tree AND bn.feature = bs.feature AND bn.half = 1 GROUP BY bs.tree, bs.feature, bs.bin, gain",
}
