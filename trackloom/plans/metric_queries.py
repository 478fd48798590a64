"""Queries over predictions: regression, distribution, TTC, rollouts, slices, long tail."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom import constants as K
from trackloom.functions import columns as C
from trackloom.operators import bounded, distribution, longtail, metrics, neighbors, scoring, slice_kernels, slice_quantiles, slices, trajectories, transitions, ttc
from trackloom.plans import views as V
from trackloom.session import materialize
from trackloom.plans.registry import query, r, rounded, with_blocks

KEY = ["dataset", "scene_id", "track_id"]
ROW = [*KEY, "frame_k"]


def predicted(spark, d):
    w = V.kept_windows(spark, d)
    return metrics.join_predictions(w, V.predictions(w))


def wide_predictions(spark, d):
    """One row per window with slice features, the truth and one column pair per model."""
    w = slices.with_slice_features(V.kept_windows(spark, d))
    last = F.element_at("state", -1)
    pa, pb = last[1].cast("double"), last[3].cast("double")
    return w.withColumns({
        "ax_true": F.col("action")[0].cast("double"), "ay_true": F.col("action")[1].cast("double"),
        "ax_persistence": pa, "ay_persistence": pb, "ax_damped": pa * 0.5, "ay_damped": pb * 0.5,
        "ax_biased": pa * 0.8 + 0.3, "ay_biased": pb * 0.8 - 0.1,
    })


_ERR = """
err AS (SELECT *, ax_pred - ax_true AS ex, ay_pred - ay_true AS ey FROM pred)"""
ERROR_BLOCKS = [*V.PREDICTION_BLOCKS, _ERR]


@query("J10 P16", with_blocks(
    "SELECT dataset, scene_id, track_id, frame_k, model, round(abs(ex), 5) AS err_x, round(sqrt(ex * ex + ey * ey), 5) AS err_norm FROM err", *ERROR_BLOCKS))
def prediction_errors(spark, d):
    return rounded(predicted(spark, d).select(*ROW, "model", "err_x", "err_norm"), ["err_x", "err_norm"], 5)


_R2 = {
    "r2_floor": "1 - {res} / greatest({tot}, 1e-12)",
    "r2_zero_var": "CASE WHEN {tot} > 0 THEN 1 - {res} / {tot} WHEN {res} <= 0 THEN 1 ELSE 0 END",
    "r2_unit_denom": "1 - {res} / CASE WHEN {tot} > 0 THEN {tot} ELSE 1 END",
}


def _regression_sql(group: str, source: str) -> str:
    axes = []
    for a in "xy":
        axes.append(f"round(sqrt(res_{a} / samples), 5) AS rmse_{a}, round(mae_{a}, 5) AS mae_{a}, round(sd_{a}, 5) AS target_std_{a}")
        axes += [f"round({e.format(res=f'res_{a}', tot=f'tot_{a}')}, 5) AS {n}_{a}" for n, e in _R2.items()]
    return f"""SELECT {group}, samples, {', '.join(axes)} FROM (
      SELECT {{select}}, count(*) AS samples, sum(ex * ex) AS res_x, sum(ey * ey) AS res_y, avg(abs(ex)) AS mae_x, avg(abs(ey)) AS mae_y,
             stddev_pop(ax_true) AS sd_x, stddev_pop(ay_true) AS sd_y,
             var_pop(ax_true) * count(*) AS tot_x, var_pop(ay_true) * count(*) AS tot_y FROM {source} GROUP BY {{group}})"""


_REG_COLS = [f"{m}_{a}" for m in ("rmse", "mae", "target_std", "r2_floor", "r2_zero_var", "r2_unit_denom") for a in "xy"]


@query("A4 A5 A13 E8", with_blocks(
    _regression_sql("model, dataset", "err").format(
        select="coalesce(model, '(all)') AS model, coalesce(dataset, '(all)') AS dataset", group="ROLLUP (model, dataset)"), *ERROR_BLOCKS))
def regression_by_dataset(spark, d):
    out = metrics.regression(predicted(spark, d), ["model", "dataset"], rollup=True)
    out = out.withColumns({"model": F.coalesce("model", F.lit("(all)")), "dataset": F.coalesce("dataset", F.lit("(all)"))})
    return rounded(out.select("model", "dataset", "samples", *_REG_COLS), _REG_COLS, 5)


@query("A12", with_blocks(
    "SELECT model, round(sqrt(avg((a - b) * (a - b))), 5) AS rmse, count(a - b) AS n FROM ("
    "SELECT model, CASE WHEN frame_k % 7 = 0 THEN NULL ELSE ax_pred END AS a, CASE WHEN frame_k % 5 = 0 THEN NULL ELSE ax_true END AS b FROM pred) GROUP BY 1",
    *V.PREDICTION_BLOCKS))
def masked_rmse(spark, d):
    p = predicted(spark, d).withColumns({
        "a": F.when(F.col("frame_k") % 7 == 0, float("nan")).otherwise(F.col("ax_pred")),
        "b": F.when(F.col("frame_k") % 5 == 0, float("inf")).otherwise(F.col("ax_true"))})
    return rounded(metrics.masked_rmse(p, ["model"], "a", "b"), ["rmse"], 5)


@query("J13", with_blocks("""
SELECT dataset, scene_id, track_id, frame_k, round(max(err) FILTER (model = 'persistence'), 5) AS persistence,
       round(max(err) FILTER (model = 'damped'), 5) AS damped, round(max(err) FILTER (model = 'biased'), 5) AS biased
FROM (SELECT *, abs(ex) AS err FROM err WHERE NOT (model = 'biased' AND frame_k % 3 = 0)) GROUP BY 1, 2, 3, 4 HAVING count(*) = 3""", *ERROR_BLOCKS))
def method_comparison(spark, d):
    p = predicted(spark, d).where("NOT (model = 'biased' AND frame_k % 3 = 0)")
    return rounded(metrics.compare_methods(p, ROW, V.MODELS, "err_x"), V.MODELS, 5)


@query("P18", with_blocks("""
SELECT model, m AS metric, round(CASE WHEN m = 'rmse_x' THEN rmse_x ELSE rmse_y END, 5) AS value, samples FROM (
  SELECT model, count(*) AS samples, sqrt(avg(ex * ex)) AS rmse_x, sqrt(avg(ey * ey)) AS rmse_y FROM err GROUP BY 1),
  (SELECT unnest(['rmse_x', 'rmse_y']) AS m)""", *ERROR_BLOCKS))
def long_results(spark, d):
    wide = metrics.regression(predicted(spark, d), ["model"])
    out = metrics.to_long(wide, ["model"], ["rmse_x", "rmse_y"], ["samples"])
    return out.select("model", "metric", r("value", 5).alias("value"), F.get_json_object("detail", "$.samples").cast("long").alias("samples"))


_KER = "(" + " + ".join(f"exp(-({{d}}) / {2 * b * b:.1f}e0)" for b in K.KERNEL_BANDWIDTHS) + ") / 4e0"


def _k(ax: str, ay: str, bx: str, by: str) -> str:
    return _KER.format(d=f"({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by})")


_EXACT_MMD = f"""
sums AS (
  SELECT a.model, a.dataset, max(c.n) AS n, sum({_k('a.ax_pred', 'a.ay_pred', 'b.ax_pred', 'b.ay_pred')}) AS xx,
         sum({_k('a.ax_true', 'a.ay_true', 'b.ax_true', 'b.ay_true')}) AS yy, sum({_k('a.ax_pred', 'a.ay_pred', 'b.ax_true', 'b.ay_true')}) AS xy
  FROM pred a JOIN pred b USING (model, dataset) JOIN (SELECT model, dataset, count(*) AS n FROM pred GROUP BY 1, 2) c USING (model, dataset) GROUP BY 1, 2),
ustat AS (SELECT *, (xx - n) / (n * (n - 1e0)) + (yy - n) / (n * (n - 1e0)) - 2 * xy / (n * 1e0 * n) AS u FROM sums)"""


@query("A6 P11", with_blocks(
    "SELECT model, dataset, n, round(greatest(0, CASE WHEN u < -1e-12 THEN (xx + yy - 2 * xy) / (n * 1e0 * n) ELSE u END), 6) AS mmd2 FROM ustat",
    *V.PREDICTION_BLOCKS, _EXACT_MMD))
def mmd_exact(spark, d):
    out = distribution.mmd2_exact(predicted(spark, d), ["model", "dataset"])
    return rounded(out.select("model", "dataset", "n", "mmd2"), ["mmd2"])


_PAIR = [("ax_pred", "ay_pred"), ("ax_true", "ay_true")]
_LINEAR_MMD = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY dataset, scene_id, track_id, frame_k) - 1 AS p FROM pred),
paired AS (SELECT a.model, {_k('a.ax_pred', 'a.ay_pred', 'b.ax_pred', 'b.ay_pred')} + {_k('a.ax_true', 'a.ay_true', 'b.ax_true', 'b.ay_true')}
  - {_k('a.ax_pred', 'a.ay_pred', 'b.ax_true', 'b.ay_true')} - {_k('b.ax_pred', 'b.ay_pred', 'a.ax_true', 'a.ay_true')} AS t
  FROM ordered a JOIN ordered b ON a.model = b.model AND b.p = a.p + 1 AND a.p % 2 = 0)"""


def _order_chunk():
    return bounded.frame_chunk("frame_k", 24576)


@query("A7", with_blocks(
    "SELECT model, 2 * count(*) AS n, round(greatest(0, 2 * avg(t)), 6) AS mmd2 FROM paired GROUP BY 1", *V.PREDICTION_BLOCKS, _LINEAR_MMD))
def mmd_linear(spark, d):
    out = distribution.mmd2_linear(predicted(spark, d), ["model"], KEY, ["frame_k"], _order_chunk(), fallback=False)
    return rounded(out.select("model", "n", "mmd2"), ["mmd2"])


@query("A6", with_blocks("SELECT model, dataset, n, round((xx + yy - 2 * xy) / (n * 1e0 * n), 6) AS mmd2 FROM sums", *V.PREDICTION_BLOCKS, _EXACT_MMD))
def mmd_v_statistic(spark, d):
    out = distribution.mmd2_v(predicted(spark, d), ["model", "dataset"])
    return rounded(out.select("model", "dataset", "n", "mmd2"), ["mmd2"])


@query("A8", with_blocks("""
SELECT model, 2 * count(*) AS n, round(greatest(0, CASE WHEN 2 * avg(t) < -1e-12 THEN any_value(v) ELSE 2 * avg(t) END), 6) AS mmd2,
       round(sqrt(greatest(0, CASE WHEN 2 * avg(t) < -1e-12 THEN any_value(v) ELSE 2 * avg(t) END)), 6) AS mmd
FROM paired JOIN (SELECT model, (xx + yy - 2 * xy) / (n * 1e0 * n) AS v FROM whole) USING (model) GROUP BY 1""", *V.PREDICTION_BLOCKS, _LINEAR_MMD,
    _EXACT_MMD.split("ustat AS")[0].rstrip().rstrip(",").replace("sums AS", "whole AS").replace("a.model, a.dataset,", "a.model,").replace("USING (model, dataset)", "USING (model)").replace("SELECT model, dataset, count(*)", "SELECT model, count(*)").replace("GROUP BY 1, 2)", "GROUP BY 1)")))
def mmd_with_fallback(spark, d):
    """Linear-time, with the V-statistic where that estimate is negative."""
    return rounded(distribution.mmd2(predicted(spark, d), ["model"], KEY, ["frame_k"], _order_chunk(), "linear").select("model", "n", "mmd2", "mmd"), ["mmd2", "mmd"])


_TTC = """
tt AS (SELECT *, CAST(state[12][5] AS DOUBLE) AS front,
       sqrt(CAST(state[12][1] AS DOUBLE) * state[12][1] + CAST(state[12][3] AS DOUBLE) * state[12][3]) AS speed FROM pred),
tv AS (SELECT *, CASE WHEN front > 0 AND front < 120 AND speed > 5e-1 THEN front / greatest(speed + ax_pred * 1e0, 5e-1) END AS tp0,
              CASE WHEN front > 0 AND front < 120 AND speed > 5e-1 THEN front / greatest(speed + ax_true * 1e0, 5e-1) END AS tt0 FROM tt),
ttc AS (SELECT *, CASE WHEN tp0 BETWEEN 0 AND 5 THEN tp0 END AS ttc_pred, CASE WHEN tt0 BETWEEN 0 AND 5 THEN tt0 END AS ttc_true FROM tv)"""
TTC_BLOCKS = [*V.PREDICTION_BLOCKS, _TTC]


def with_ttc(spark, d):
    return ttc.window_values(predicted(spark, d), 1.0)


@query("H8", with_blocks(
    "SELECT dataset, scene_id, track_id, frame_k, model, round(ttc_pred, 5) AS ttc_pred, round(ttc_true, 5) AS ttc_true FROM ttc "
    "WHERE ttc_pred IS NOT NULL OR ttc_true IS NOT NULL", *TTC_BLOCKS))
def window_ttc(spark, d):
    t = with_ttc(spark, d).where("ttc_pred IS NOT NULL OR ttc_true IS NOT NULL")
    return rounded(t.select(*ROW, "model", "ttc_pred", "ttc_true"), ["ttc_pred", "ttc_true"], 5)


def _peak_sql(value: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT model, least(99, CAST(floor({value} * 2e1) AS BIGINT)) AS bin, count(*) AS n FROM ttc WHERE {value} IS NOT NULL GROUP BY 1, 2),
{name}_g AS (SELECT model, unnest(range(100)) AS bin FROM (SELECT DISTINCT model FROM {name}_c)),
{name}_s AS (SELECT model, bin, sum(coalesce(n, 0)) OVER (PARTITION BY model ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s
             FROM {name}_g LEFT JOIN {name}_c USING (model, bin)),
{name} AS (SELECT model, n_values, CASE WHEN n_values >= 20 THEN (min(bin) FILTER (s = top) + 5e-1) * 5e-2 END AS peak
           FROM (SELECT *, max(s) OVER (PARTITION BY model) AS top FROM {name}_s) JOIN (SELECT model, sum(n) AS n_values FROM {name}_c GROUP BY 1) USING (model) GROUP BY model, n_values)"""


_PROBS = "[" + ", ".join(f"{p!r}e0" for p in ttc.QUANTILE_GRID) + "]"
_TTC_ERR = f"""
{_peak_sql('ttc_pred', 'pk_p')}, {_peak_sql('ttc_true', 'pk_t')},
qs AS (SELECT model, quantile_cont(ttc_pred, {_PROBS}) AS qp, quantile_cont(ttc_true, {_PROBS}) AS qt, least(count(ttc_pred), count(ttc_true)) AS n_ttc FROM ttc GROUP BY 1),
qe AS (SELECT model, n_ttc, CASE WHEN n_ttc >= 20 THEN (SELECT sqrt(avg((a - b) * (a - b))) FROM (SELECT unnest(qp) AS a, unnest(qt) AS b)) END AS q FROM qs),
ee AS (SELECT qe.model, n_ttc, abs(pk_p.peak - pk_t.peak) AS pe, q FROM qe JOIN pk_p USING (model) JOIN pk_t USING (model))"""


@query("A14 A15 A16", with_blocks("""
SELECT model, n_ttc, round(pe, 5) AS peak_error, round(q, 5) AS quantile_error,
       round((CASE WHEN pe IS NULL THEN q WHEN pe = 0 AND q > 0 THEN greatest(q, 5e-2) ELSE pe END) + coalesce(least(q, 2e-2), 0), 5) AS ttc_error
FROM ee""", *TTC_BLOCKS, _TTC_ERR))
def ttc_errors(spark, d):
    out = ttc.error_report(with_ttc(spark, d), ["model"])
    cols = ["peak_error", "quantile_error", "ttc_error"]
    return rounded(out.select("model", "n_ttc", *cols), cols, 5)


_NEAREST = """
nn AS (SELECT e.dataset, e.scene_id, e.track_id, e.frame, sqrt(e.vx * e.vx + e.vy * e.vy) AS speed,
              min_by(sqrt(o.vx * o.vx + o.vy * o.vy), (sqrt((o.x - e.x) * (o.x - e.x) + (o.y - e.y) * (o.y - e.y)), o.track_id)) AS ns,
              min(sqrt((o.x - e.x) * (o.x - e.x) + (o.y - e.y) * (o.y - e.y))) AS d
       FROM veh e LEFT JOIN veh o ON e.recording = o.recording AND e.frame = o.frame AND e.track_id <> o.track_id
       GROUP BY e.dataset, e.scene_id, e.track_id, e.frame, e.vx, e.vy),
ft AS (SELECT *, CASE WHEN d IS NULL THEN NULL WHEN abs(speed - ns) <= 1e-3 THEN CAST('Infinity' AS DOUBLE) ELSE d / abs(speed - ns) END AS ttc FROM nn)"""


def frame_ttc_rows(spark, d):
    near = neighbors.nearest_neighbor(V.vehicles(spark, d))
    return near.withColumn("ttc", C.frame_ttc(F.col("distance"), F.abs(F.col("speed") - F.col("neighbor_speed"))))


@query("J11 H9 P22", with_blocks(
    "SELECT dataset, scene_id, track_id, frame, round(d, 5) AS distance, CASE WHEN ttc IS NULL THEN 'none' WHEN isinf(ttc) THEN 'inf' ELSE 'finite' END AS kind, "
    "round(CASE WHEN NOT isinf(ttc) THEN ttc END, 4) AS ttc FROM ft", *V.BASE, _NEAREST))
def frame_ttc(spark, d):
    t = frame_ttc_rows(spark, d)
    inf = F.col("ttc") == float("inf")
    return t.select(*KEY, "frame", r("distance", 5).alias("distance"),
                    F.when(F.col("ttc").isNull(), "none").when(inf, "inf").otherwise("finite").alias("kind"),
                    r(F.when(~inf, F.col("ttc")), 4).alias("ttc"))


@query("A17", with_blocks("""
SELECT dataset, scene_id, track_id, round(min(f), 4) AS ttc_min, round(avg(f), 4) AS ttc_mean, round(quantile_cont(f, 5e-1), 4) AS ttc_median,
       round(quantile_cont(f, 5e-2), 4) AS ttc_p05, round(quantile_cont(f, 95e-2), 4) AS ttc_p95, round(count(f) / (count(*) * 1e0), 5) AS ttc_finite_ratio
FROM (SELECT *, CASE WHEN NOT isinf(ttc) THEN ttc END AS f FROM ft WHERE ttc IS NOT NULL) GROUP BY 1, 2, 3""", *V.BASE, _NEAREST))
def ttc_summary(spark, d):
    # Written, because the summary reads the series twice and the search is the dear part.
    out = ttc.series_summary(materialize(frame_ttc_rows(spark, d), "frame-ttc"), KEY)
    cols = ["ttc_min", "ttc_mean", "ttc_median", "ttc_p05", "ttc_p95"]
    return rounded(out.withColumn("ttc_finite_ratio", r("ttc_finite_ratio", 5)), cols, 4)


# ---- trajectories -------------------------------------------------------------------------------------

MIN_STEPS = 20

_SEGMENTS = """
flagged AS (SELECT *, CASE WHEN frame_k - lag(frame_k) OVER t = 12 THEN 0 ELSE 1 END AS brk FROM kept WINDOW t AS (PARTITION BY dataset, scene_id, track_id ORDER BY frame_k)),
numbered AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY dataset, scene_id, track_id ORDER BY frame_k) AS BIGINT) AS segment FROM flagged),
segs AS (SELECT dataset, scene_id, track_id, segment, min(frame_k) AS frame_k_start, max(frame_k) AS frame_k_end, count(*) AS windows,
                count(*) * 12 - 11 AS pred_steps FROM numbered GROUP BY 1, 2, 3, 4),
long_segs AS (SELECT * FROM segs WHERE pred_steps >= 20)"""
SEGMENT_BLOCKS = [*V.WINDOW_BLOCKS, _SEGMENTS]


@query("W5", with_blocks("SELECT * FROM segs", *SEGMENT_BLOCKS))
def segments(spark, d):
    return trajectories.segment_table(trajectories.split_segments(V.kept_windows(spark, d)))


_TILING = """
tiles AS (SELECT a.dataset, a.scene_id, a.track_id, a.segment, b.frame_k,
  list_max(list_transform(range(1, 13), lambda i: abs(CAST(a.next_state[12][i] AS DOUBLE) - CAST(b.state[1][i] AS DOUBLE)))) AS diff
  FROM numbered a JOIN numbered b ON a.dataset = b.dataset AND a.scene_id = b.scene_id AND a.track_id = b.track_id AND a.segment = b.segment AND b.frame_k = a.frame_k + 12
  JOIN long_segs s ON s.dataset = a.dataset AND s.scene_id = a.scene_id AND s.track_id = a.track_id AND s.segment = a.segment)"""


@query("A25 J12", with_blocks("""
SELECT (SELECT count(*) FROM segs) AS segments_total, (SELECT count(*) FROM segs WHERE pred_steps < 20) AS segments_short,
       (SELECT count(*) FROM long_segs) AS segments_selected, (SELECT max(pred_steps) FROM long_segs) AS pred_steps_max,
       (SELECT count(*) FROM tiles) AS tiling_checks, (SELECT count(*) FROM tiles WHERE diff > 1e-4) AS tiling_bad,
       (SELECT round(coalesce(max(diff), 0), 5) FROM tiles) AS tiling_max_diff,
       (SELECT quantile_cont(pred_steps, 5e-1) FROM long_segs) AS pred_steps_p50,
       (SELECT quantile_cont(pred_steps, 9e-1) FROM long_segs) AS pred_steps_p90,
       (SELECT round(quantile_cont(pred_steps, 99e-2), 5) FROM long_segs) AS pred_steps_p99""", *SEGMENT_BLOCKS, _TILING))
def reconstruction_report(spark, d):
    out = trajectories.reconstruction_report(V.kept_windows(spark, d), MIN_STEPS)
    return rounded(out, ["tiling_max_diff", "pred_steps_p99"], 5)


_STEPS = """
pieces AS (SELECT n.dataset, n.scene_id, n.track_id, n.segment, l.frame_k_start, l.frame_k_end, l.windows, n.frame_k - l.frame_k_start AS base,
                  CASE WHEN n.frame_k = l.frame_k_end THEN list_append(n.state, n.next_state[12]) ELSE n.state END AS rows_
           FROM numbered n JOIN long_segs l USING (dataset, scene_id, track_id, segment)),
steps AS (SELECT dataset, scene_id, track_id, segment, frame_k_start, frame_k_end, windows, base + generate_subscripts(rows_, 1) - 1 AS step, unnest(rows_) AS f FROM pieces),
moves AS (SELECT *, CAST(f[1] AS DOUBLE) AS vx, CAST(f[2] AS DOUBLE) AS ax, CAST(f[3] AS DOUBLE) AS vy, CAST(f[4] AS DOUBLE) AS ay FROM steps),
lagged AS (SELECT *, lag(vx) OVER t AS pvx, lag(vy) OVER t AS pvy, lag(ax) OVER t AS pax, lag(ay) OVER t AS pay FROM moves
           WINDOW t AS (PARTITION BY dataset, scene_id, track_id, segment ORDER BY step))"""
STEP_BLOCKS = [*SEGMENT_BLOCKS, _STEPS]

_DT = "CASE dataset WHEN 'inD' THEN 1e0 / 25e0 WHEN 'DJI' THEN 1e0 / 30e0 ELSE 1e0 / 10e0 END"
_SEG = "dataset, scene_id, track_id, segment"


def _rollout_sql(mode: str) -> str:
    start = ("coalesce(v0x, 0)", "coalesce(v0y, 0)")
    vel = {a: (f"v0{a} + dt * sum(a{a}_pred) OVER t" if mode == "semi" else f"pv{a} + dt * a{a}_pred") for a in "xy"}
    return f"""
modelled AS (
  SELECT m.*, {_DT} AS dt, 'persistence' AS model, pax AS ax_pred, pay AS ay_pred FROM lagged m WHERE step >= 12
  UNION ALL SELECT m.*, {_DT}, 'damped', pax * 5e-1, pay * 5e-1 FROM lagged m WHERE step >= 12
  UNION ALL SELECT m.*, {_DT}, 'biased', pax * 8e-1 + 3e-1, pay * 8e-1 - 1e-1 FROM lagged m WHERE step >= 12),
anchored AS (SELECT m.*, s.vx AS v0x, s.vy AS v0y FROM modelled m JOIN (SELECT {_SEG}, vx, vy FROM lagged WHERE step = 11) s USING ({_SEG})),
veled AS (SELECT *, {vel['x']} AS vx_pred, {vel['y']} AS vy_pred FROM anchored WINDOW t AS (PARTITION BY {_SEG}, model ORDER BY step)),
disp AS (SELECT *, dt * sum(vx_pred) OVER t AS dx_pred, dt * sum(vy_pred) OVER t AS dy_pred, dt * sum(vx) OVER t AS dx_true, dt * sum(vy) OVER t AS dy_true
         FROM veled WINDOW t AS (PARTITION BY {_SEG}, model ORDER BY step)),
rolled AS (SELECT *, sqrt((dx_pred - dx_true) * (dx_pred - dx_true) + (dy_pred - dy_true) * (dy_pred - dy_true)) AS err FROM disp)"""


def step_predictions(steps):
    later = steps.where(F.col("step") >= K.HISTORY)
    spec = [("persistence", 1.0, 0.0, 0.0), ("damped", 0.5, 0.0, 0.0), ("biased", 0.8, 0.3, -0.1)]
    preds = F.array(*[
        F.struct(F.lit(n).alias("model"), (F.col("prev_ax") * g + bx).alias("ax_pred"), (F.col("prev_ay") * g + by).alias("ay_pred"))
        for n, g, bx, by in spec])
    return later.select(*trajectories.SEGMENT, "step", F.explode(preds).alias("_p")).select(*trajectories.SEGMENT, "step", "_p.*")


def derive_rollout(spark, d, mode="semi"):
    steps = trajectories.reconstruct(V.kept_windows(spark, d), MIN_STEPS)
    return trajectories.rollout_steps(steps, step_predictions(steps), mode)


def rollout(spark, d):
    # Without what no query reads, so that it is not shuffled either.
    return V.landed(spark, d, "rollout", lambda: derive_rollout(spark, d).drop("prev_vx", "prev_ax", "prev_vy", "prev_ay", "pred_steps"))


@query("W6", with_blocks(
    f"SELECT {_SEG}, step, round(vx, 5) AS vx, round(ax, 5) AS ax, round(pvx, 5) AS prev_vx, round(pay, 5) AS prev_ay FROM lagged", *STEP_BLOCKS))
def reconstructed_steps(spark, d):
    s = trajectories.reconstruct(V.kept_windows(spark, d), MIN_STEPS)
    cols = ["vx", "ax", "prev_vx", "prev_ay"]
    return rounded(s.select(*trajectories.SEGMENT, "step", *cols), cols, 5)


_ROLL_OUT = f"SELECT {_SEG}, model, step, round(vx_pred, 5) AS vx_pred, round(dx_pred, 5) AS dx_pred, round(dy_true, 5) AS dy_true, round(err, 5) AS err FROM rolled"
_ROLL_COLS = ["vx_pred", "dx_pred", "dy_true", "err"]


@query("W7", with_blocks(_ROLL_OUT, *STEP_BLOCKS, _rollout_sql("semi")))
def rollout_semi(spark, d):
    return rounded(rollout(spark, d).select(*trajectories.SEGMENT, "model", "step", *_ROLL_COLS), _ROLL_COLS, 5)


@query("W7", with_blocks(_ROLL_OUT, *STEP_BLOCKS, _rollout_sql("teacher")))
def rollout_teacher(spark, d):
    rolled = derive_rollout(spark, d, "teacher")
    return rounded(rolled.select(*trajectories.SEGMENT, "model", "step", *_ROLL_COLS), _ROLL_COLS, 5)


_TRAJ = f"""
traj AS (
  SELECT {_SEG}, model, frame_k_start, frame_k_end, windows, count(*) AS pred_steps, avg(err) AS ade, max_by(err, step) AS fde,
         max_by(sqrt(dx_true * dx_true + dy_true * dy_true), step) AS true_path_len,
         max_by(sqrt(dx_pred * dx_pred + dy_pred * dy_pred), step) AS pred_path_len,
         quantile_cont((sqrt(vx_pred * vx_pred + vy_pred * vy_pred) + 1e-9) * sqrt(ax_pred * ax_pred + ay_pred * ay_pred), 95e-2) AS va95_pred,
         quantile_cont((sqrt(vx * vx + vy * vy) + 1e-9) * sqrt(ax * ax + ay * ay), 95e-2) AS va95_true,
         sum(sqrt(vx_pred * vx_pred + vy_pred * vy_pred) * sqrt(ax_pred * ax_pred + ay_pred * ay_pred) * dt) / nullif(sum(sqrt(vx_pred * vx_pred + vy_pred * vy_pred) * dt), 0) AS rpa_pred,
         sum(sqrt(vx * vx + vy * vy) * sqrt(ax * ax + ay * ay) * dt) / nullif(sum(sqrt(vx * vx + vy * vy) * dt), 0) AS rpa_true,
         sum((ax_pred - ax) * (ax_pred - ax)) AS sse_ax, sum(abs(ay_pred - ay)) AS sae_ay,
         max(greatest(abs(ax_pred), abs(ay_pred))) AS max_abs_pred, max(greatest(abs(ax), abs(ay))) AS max_abs_true
  FROM rolled GROUP BY {_SEG}, model, frame_k_start, frame_k_end, windows),
trajc AS (SELECT *, greatest(2e0, true_path_len * 5e-2) AS cr_threshold, CAST(fde <= greatest(2e0, true_path_len * 5e-2) AS BIGINT) AS complete FROM traj)"""
TRAJ_BLOCKS = [*STEP_BLOCKS, _rollout_sql("semi"), _TRAJ]
_TRAJ_COLS = ["ade", "fde", "true_path_len", "pred_path_len", "cr_threshold", "va95_pred", "va95_true", "rpa_pred", "rpa_true"]


def trajectory_rows(spark, d):
    return V.landed(spark, d, "trajectory_rows", lambda: trajectories.trajectory_metrics(rollout(spark, d)))


@query("W8 W9 A9 A10 E10", with_blocks(
    f"SELECT {_SEG}, model, frame_k_start, frame_k_end, windows, pred_steps, complete, " + ", ".join(f"round({c}, 5) AS {c}" for c in _TRAJ_COLS) + " FROM trajc", *TRAJ_BLOCKS))
def trajectory_metrics(spark, d):
    t = trajectories.trajectory_metrics(rollout(spark, d))
    return rounded(t.select(*trajectories.SEGMENT, "model", "frame_k_start", "frame_k_end", "windows", "pred_steps", "complete", *_TRAJ_COLS), _TRAJ_COLS, 5)


_SUM = {
    "ade_mean": "avg(ade)", "ade_median": "quantile_cont(ade, 5e-1)", "ade_p90": "quantile_cont(ade, 9e-1)",
    "fde_mean": "avg(fde)", "fde_median": "quantile_cont(fde, 5e-1)", "fde_p90": "quantile_cont(fde, 9e-1)", "fde_p95": "quantile_cont(fde, 95e-2)",
    "fde_p99": "quantile_cont(fde, 99e-2)", "fde_max": "max(fde)", "cr_threshold_rate": "avg(complete)",
    "true_path_len_mean": "avg(true_path_len)", "pred_path_len_mean": "avg(pred_path_len)",
    "steps_per_traj_mean": "avg(pred_steps)", "steps_per_traj_p90": "quantile_cont(pred_steps, 9e-1)",
    "va95_pred_mean": "avg(va95_pred)", "va95_true_mean": "avg(va95_true)", "va95_rmse": "sqrt(avg((va95_pred - va95_true) * (va95_pred - va95_true)))",
    "rpa_pred_mean": "avg(rpa_pred)", "rpa_rmse": "sqrt(avg((rpa_pred - rpa_true) * (rpa_pred - rpa_true)))",
    "acc_rmse_x": "sqrt(sum(sse_ax) / sum(pred_steps))", "acc_mae_y": "sum(sae_ay) / sum(pred_steps)",
}


@query("A11 A24 E7 P19", with_blocks(
    "SELECT model, dataset, count(*) AS trajectories, CAST(sum(pred_steps) AS BIGINT) AS pred_steps, " + ", ".join(f"round({e}, 4) AS {n}" for n, e in _SUM.items())
    + " FROM trajc GROUP BY 1, 2", *TRAJ_BLOCKS))
def trajectory_summary(spark, d):
    out = trajectories.trajectory_summary(trajectory_rows(spark, d), ["model", "dataset"])
    return rounded(out.select("model", "dataset", "trajectories", "pred_steps", *_SUM), list(_SUM), 4)


@query("A26", with_blocks(
    "SELECT model, dataset, round(avg(greatest(0, least(1, 1 - fde / greatest(3 * true_path_len, 1e-6)))), 5) AS cr_clipped FROM trajc GROUP BY 1, 2", *TRAJ_BLOCKS))
def clipped_completion(spark, d):
    t = trajectory_rows(spark, d)
    return t.groupBy("model", "dataset").agg(r(F.avg(C.clipped_completion(F.col("fde"), F.col("true_path_len"))), 5).alias("cr_clipped"))


@query("E9", with_blocks(
    f"SELECT {_SEG}, model, step, round(ax, 5) AS ax, round(ax_pred, 5) AS ax_pred FROM rolled r WHERE NOT EXISTS ("
    "SELECT 1 FROM rolled b WHERE b.dataset = r.dataset AND b.scene_id = r.scene_id AND b.track_id = r.track_id AND b.segment = r.segment AND abs(b.ax) > 39e-1)",
    *STEP_BLOCKS, _rollout_sql("semi")))
def acceleration_series(spark, d):
    return rounded(trajectories.acceleration_series(rollout(spark, d), 3.9), ["ax", "ax_pred"], 5)


@query("P21 P23 P24", with_blocks(f"""
SELECT model, count(*) AS n, round(avg(ade), 4) AS ade, round(avg(fde), 4) AS fde, round(avg(va95_pred), 4) AS va95, round(avg(rpa_pred), 4) AS rpa
FROM trajc JOIN (
  SELECT {_SEG} FROM (SELECT {_SEG}, max(max_abs_true) AS m FROM traj GROUP BY ALL) WHERE m <= 1e1
  ORDER BY CAST(concat('0x', substr(md5(concat_ws('/', dataset, scene_id, track_id, CAST(segment AS VARCHAR), '7')), 1, 15)) AS BIGINT), {_SEG} LIMIT 20)
  USING ({_SEG})
WHERE max_abs_pred <= 1e1 GROUP BY 1""", *TRAJ_BLOCKS))
def common_sample(spark, d):
    """One sampled set of trajectories, the same for every model."""
    from trackloom.operators.cleaning import seeded_sample

    t = trajectory_rows(spark, d)
    valid = t.where(F.col("max_abs_true") <= 10.0).select(*trajectories.SEGMENT).distinct()
    keys = seeded_sample(valid, trajectories.SEGMENT, 20, seed=7)
    rows = trajectories.within_acceleration_limit(t.join(keys, trajectories.SEGMENT, "left_semi"))
    out = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("ade").alias("ade"), F.avg("fde").alias("fde"),
                                    F.avg("va95_pred").alias("va95"), F.avg("rpa_pred").alias("rpa"))
    return rounded(out, ["ade", "fde", "va95", "rpa"], 4)


@query("E6", with_blocks("""
SELECT model, count(*) AS trajectories, round(any_value(lo), 5) AS value_lo, round(any_value(hi), 5) AS value_hi, round(avg(ade), 5) AS ade, round(avg(fde), 5) AS fde,
       round(avg(greatest(0, least(1, 1 - fde / greatest(3 * true_path_len, 1e-6)))), 5) AS cr_clipped
FROM trajc JOIN (
  SELECT dataset, scene_id, track_id, segment, lo, hi FROM trajc, (SELECT quantile_cont(true_path_len, 2e-1) AS lo, quantile_cont(true_path_len, 8e-1) AS hi FROM trajc WHERE model = 'damped')
  WHERE model = 'damped' AND true_path_len >= lo AND true_path_len <= hi) USING (dataset, scene_id, track_id, segment)
GROUP BY 1""", *TRAJ_BLOCKS))
def common_subset(spark, d):
    out = slices.common_subset(trajectory_rows(spark, d), "all", F.col("true_path_len"), 0.2, 0.8, "damped")
    return rounded(out, ["value_lo", "value_hi", "ade", "fde", "cr_clipped"], 5)


# ---- slices --------------------------------------------------------------------------------------------

_FEATS = """
feats AS (
  SELECT dataset, scene_id, track_id, frame_k, state, ax_true, ay_true, pa, pb,
         sqrt(vx * vx + vy * vy) AS speed, sqrt(pa * pa + pb * pb) AS prev_acc, abs(pa) AS prev_ax_abs, abs(pb) AS prev_ay_abs,
         ax_true AS target_ax, abs(ax_true) AS target_ax_abs, abs(ay_true) AS target_ay_abs, sqrt(ax_true * ax_true + ay_true * ay_true) AS target_acc,
         CASE WHEN g[1] > 0 THEN g[1] END AS front_dist, list_min(list_transform(g, lambda v: greatest(0e0, least(2e2, v)))) AS min_neighbor,
         least(greatest(0e0, least(2e2, g[1])), greatest(0e0, least(2e2, g[2]))) AS min_frontback,
         list_min(list_filter(g, lambda v: v >= 0)) AS nearest_gap
  FROM (SELECT *, CAST(state[12][1] AS DOUBLE) AS vx, CAST(state[12][3] AS DOUBLE) AS vy,
               list_transform(state[12][5:12], lambda v: CAST(v AS DOUBLE)) AS g FROM base))"""
_FEATURE_NAMES = slices.FEATURES


@query("H7 H6", with_blocks(
    "SELECT dataset, scene_id, track_id, frame_k, " + ", ".join(f"round({f}, 5) AS {f}" for f in [*_FEATURE_NAMES, "nearest_gap"]) + " FROM feats",
    *V.PREDICTION_BLOCKS, _FEATS))
def slice_features(spark, d):
    w = slices.with_slice_features(V.kept_windows(spark, d))
    cols = [*_FEATURE_NAMES, "nearest_gap"]
    return rounded(w.select(*ROW, *cols), cols, 5)


def _long_sql(features: list[str]) -> str:
    each = " UNION ALL ".join(
        f"SELECT {s} AS scope, '{f}' AS feature, {f} AS value, feats.* FROM feats WHERE {f} IS NOT NULL" for f in features for s in ("'all'", "dataset"))
    return f"longf AS ({each})"


def _slices_sql(ranges) -> str:
    rs = ", ".join(f"({lo}e0, {hi}e0)" for lo, hi in ranges)
    return f"""
bounds AS (SELECT scope, feature, q_lo, q_hi, list_sort(list(value)) AS vs, count(*) AS population FROM longf, (VALUES {rs}) q(q_lo, q_hi) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20),
posd AS (SELECT *, q_lo * (population - 1) AS pl, q_hi * (population - 1) AS ph FROM bounds),
slices AS (SELECT scope, feature, q_lo, q_hi, population,
   vs[CAST(floor(pl) AS BIGINT) + 1] + (vs[CAST(ceil(pl) AS BIGINT) + 1] - vs[CAST(floor(pl) AS BIGINT) + 1]) * (pl - floor(pl)) AS value_lo,
   vs[CAST(floor(ph) AS BIGINT) + 1] + (vs[CAST(ceil(ph) AS BIGINT) + 1] - vs[CAST(floor(ph) AS BIGINT) + 1]) * (ph - floor(ph)) AS value_hi FROM posd),
inside AS (SELECT l.*, s.q_lo, s.q_hi, s.value_lo, s.value_hi FROM longf l JOIN slices s ON l.scope = s.scope AND l.feature = s.feature AND l.value >= s.value_lo AND l.value <= s.value_hi)"""


_SWEEP = _slices_sql(K.SWEEP_RANGES)
_MODEL_COLS = {"persistence": ("pa", "pb"), "damped": ("pa * 5e-1", "pb * 5e-1"), "biased": ("pa * 8e-1 + 3e-1", "pb * 8e-1 - 1e-1")}


@query("E1", with_blocks(
    "SELECT scope, feature, q_lo, q_hi, population, round(value_lo, 5) AS value_lo, round(value_hi, 5) AS value_hi FROM slices",
    *V.PREDICTION_BLOCKS, _FEATS, _long_sql(_FEATURE_NAMES), _SWEEP))
def slice_bounds(spark, d):
    out = slices.slice_table(wide_predictions(spark, d), _FEATURE_NAMES, K.SWEEP_RANGES)
    return rounded(out, ["value_lo", "value_hi"], 5)


def _slice_metrics_sql(group: str = "scope, feature, q_lo, q_hi", source: str = "inside") -> str:
    parts = []
    for m, (px, py) in _MODEL_COLS.items():
        parts.append(
            f"SELECT {group}, '{m}' AS model, count(*) AS samples, sqrt(avg(({px} - ax_true) * ({px} - ax_true))) AS rmse_x, sqrt(avg(({py} - ay_true) * ({py} - ay_true))) AS rmse_y, "
            f"1 - sum(({px} - ax_true) * ({px} - ax_true)) / CASE WHEN var_pop(ax_true) > 1e-13 THEN var_pop(ax_true) * count(*) ELSE 1 END AS r2_x, "
            f"1 - sum(({py} - ay_true) * ({py} - ay_true)) / CASE WHEN var_pop(ay_true) > 1e-13 THEN var_pop(ay_true) * count(*) ELSE 1 END AS r2_y FROM {source} GROUP BY {group}")
    return "sm AS (" + " UNION ALL ".join(parts) + ")"


_SLICE_FEATS = _FEATURE_NAMES
SLICE_BLOCKS = [*V.PREDICTION_BLOCKS, _FEATS, _long_sql(_SLICE_FEATS), _SWEEP, _slice_metrics_sql()]


@query("E3 E5 P15 P17", with_blocks(
    "SELECT scope, feature, q_lo, q_hi, model, samples, round(rmse_x, 4) AS rmse_x, round(rmse_y, 4) AS rmse_y, "
    "row_number() OVER (PARTITION BY model ORDER BY round(rmse_x, 6), samples DESC, scope, feature, q_lo, q_hi) AS slice_rank, count(*) OVER (PARTITION BY model) AS slices_tried FROM sm", *SLICE_BLOCKS))
def slice_metrics(spark, d):
    out = slices.slice_metrics(wide_predictions(spark, d), V.MODELS, _SLICE_FEATS, K.SWEEP_RANGES)
    out = slices.ranked(out.withColumn("_by", F.round("rmse_x", 6)), "_by", ["model"])
    return rounded(out.select("scope", "feature", "q_lo", "q_hi", "model", "samples", "rmse_x", "rmse_y", "slice_rank", "slices_tried"), ["rmse_x", "rmse_y"], 4)


@query("E3", with_blocks(
    "SELECT scope, feature, q_lo, q_hi, model, samples, round(r2_x, 4) AS r2_x, round(r2_y, 4) AS r2_y FROM sm", *SLICE_BLOCKS))
def slice_r2(spark, d):
    out = slices.slice_metrics(wide_predictions(spark, d), V.MODELS, _SLICE_FEATS, K.SWEEP_RANGES)
    return rounded(out.select("scope", "feature", "q_lo", "q_hi", "model", "samples", "r2_x", "r2_y"), ["r2_x", "r2_y"], 4)


@query("E3", with_blocks(
    "SELECT scope, feature, q_lo, q_hi, model, samples, round(rmse_x, 4) AS rmse_x, round(rmse_y, 4) AS rmse_y, round(r2_x, 4) AS r2_x, round(r2_y, 4) AS r2_y FROM sm",
    *V.PREDICTION_BLOCKS, _FEATS, _long_sql(_SLICE_FEATS), _slices_sql(K.FINE_RANGES), _slice_metrics_sql()))
def slice_fine(spark, d):
    """The finer list of quantile ranges."""
    out = slices.slice_metrics(wide_predictions(spark, d), V.MODELS, _SLICE_FEATS, K.FINE_RANGES)
    return rounded(out.select("scope", "feature", "q_lo", "q_hi", "model", "samples", "rmse_x", "rmse_y", "r2_x", "r2_y"), ["rmse_x", "rmse_y", "r2_x", "r2_y"], 4)


_SLICE_MMD = f"""
preds AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, scope, feature, q_lo, q_hi, ax_true, ay_true, {x} AS px, {y} AS py FROM inside" for m, (x, y) in _MODEL_COLS.items())}),
ksum AS (
  SELECT model, scope, feature, q_lo, q_hi, sqrt(count(*)) AS n, sum({_k('a.px', 'a.py', 'b.px', 'b.py')}) AS xx,
    sum({_k('a.ax_true', 'a.ay_true', 'b.ax_true', 'b.ay_true')}) AS yy, sum({_k('a.px', 'a.py', 'b.ax_true', 'b.ay_true')}) AS xy
  FROM preds a JOIN preds b USING (model, scope, feature, q_lo, q_hi) GROUP BY 1, 2, 3, 4, 5),
kstat AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE (xx - n) / (n * (n - 1e0)) + (yy - n) / (n * (n - 1e0)) - 2 * xy / (n * n) END AS u FROM ksum)"""


@query("E3 A6", with_blocks(
    "SELECT scope, feature, q_lo, q_hi, model, CAST(round(n) AS BIGINT) AS samples, round(greatest(0, CASE WHEN u < -1e-12 THEN (xx + yy - 2 * xy) / (n * n) ELSE u END), 6) AS mmd2 FROM kstat",
    *V.PREDICTION_BLOCKS, _FEATS, _long_sql(_SLICE_FEATS), _SWEEP, _SLICE_MMD))
def slice_mmd(spark, d):
    """Exact discrepancy on every slice of every feature, from one pass over the pairs."""
    out = slice_kernels.slice_mmd(wide_predictions(spark, d), V.MODELS, _SLICE_FEATS, K.SWEEP_RANGES)
    return rounded(out.select("scope", "feature", "q_lo", "q_hi", "model", "samples", "mmd2"), ["mmd2"])


_HORIZONS = [1.0, 2.0, 3.0]


def _slice_ttc_sql() -> str:
    series = {"true": "ax_true", **{m: c[0] for m, c in _MODEL_COLS.items()}}
    parts = " UNION ALL ".join(
        f"SELECT scope, feature, q_lo, q_hi, '{m}' AS model, {h}e0 AS horizon, CAST(state[12][5] AS DOUBLE) / greatest(speed + ({c}) * {h}e0, 5e-1) AS v FROM st"
        for m, c in series.items() for h in _HORIZONS)
    k = "scope, feature, q_lo, q_hi, horizon, model"
    return f"""
st AS (SELECT i.* EXCLUDE (speed), sqrt(CAST(state[12][1] AS DOUBLE) * state[12][1] + CAST(state[12][3] AS DOUBLE) * state[12][3]) AS speed FROM inside i),
sv AS ({parts.replace('FROM st', "FROM st WHERE state[12][5] > 0 AND state[12][5] < 120 AND speed > 5e-1")}),
sc AS (SELECT {k}, least(99, CAST(floor(v * 2e1) AS BIGINT)) AS bin, count(*) AS n FROM sv WHERE v >= 0 AND v <= 5 GROUP BY ALL),
sg AS (SELECT {k}, nv, unnest(range(100)) AS bin FROM (SELECT {k}, sum(n) AS nv FROM sc GROUP BY ALL)),
ss AS (SELECT {k}, nv, bin, sum(coalesce(n, 0)) OVER (PARTITION BY {k} ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM sg LEFT JOIN sc USING ({k}, bin)),
sp AS (SELECT {k}, nv, CASE WHEN nv >= 20 THEN (min(bin) FILTER (s = top) + 5e-1) * 5e-2 END AS peak FROM (SELECT *, max(s) OVER (PARTITION BY {k}) AS top FROM ss) GROUP BY {k}, nv)"""


_TTC_FEATS = _SLICE_FEATS


@query("E3 A14", with_blocks(
    "SELECT a.scope, a.feature, a.q_lo, a.q_hi, a.horizon, a.model, CAST(a.nv AS BIGINT) AS n_ttc, round(abs(a.peak - b.peak), 5) AS peak_error "
    "FROM sp a JOIN sp b USING (scope, feature, q_lo, q_hi, horizon) WHERE a.model <> 'true' AND b.model = 'true'",
    *V.PREDICTION_BLOCKS, _FEATS, _long_sql(_TTC_FEATS), _SWEEP, _slice_ttc_sql()))
def slice_ttc_peaks(spark, d):
    out = slices.slice_ttc_peaks(wide_predictions(spark, d), V.MODELS, _TTC_FEATS, K.SWEEP_RANGES, _HORIZONS)
    return rounded(out, ["peak_error"], 5)


_SLICE_TTC_ERR = f"""
sq AS (SELECT scope, feature, q_lo, q_hi, horizon, model, quantile_cont(v, {_PROBS}) AS q, count(*) AS n FROM sv WHERE v >= 0 AND v <= 5 GROUP BY ALL),
sb AS (
  SELECT a.scope, a.feature, a.q_lo, a.q_hi, a.horizon, a.model, least(a.n, t.n) AS n_ttc, abs(pa.peak - pt.peak) AS pe,
    CASE WHEN least(a.n, t.n) >= 20 THEN sqrt(list_avg(list_transform(list_zip(a.q, t.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END AS q
  FROM sq a JOIN sq t ON (a.scope, a.feature, a.q_lo, a.q_hi, a.horizon) = (t.scope, t.feature, t.q_lo, t.q_hi, t.horizon) AND a.model <> 'true' AND t.model = 'true'
  JOIN sp pa ON (a.scope, a.feature, a.q_lo, a.q_hi, a.horizon, a.model) = (pa.scope, pa.feature, pa.q_lo, pa.q_hi, pa.horizon, pa.model)
  JOIN sp pt ON (a.scope, a.feature, a.q_lo, a.q_hi, a.horizon) = (pt.scope, pt.feature, pt.q_lo, pt.q_hi, pt.horizon) AND pt.model = 'true')"""


@query("E3 A14 A15 A16", with_blocks("""
SELECT scope, feature, q_lo, q_hi, horizon, model, n_ttc, round(pe, 5) AS peak_error, round(q, 5) AS quantile_error,
       round((CASE WHEN pe IS NULL THEN q WHEN pe = 0 AND q > 0 THEN greatest(q, 5e-2) ELSE pe END) + coalesce(least(q, 2e-2), 0), 5) AS ttc_error
FROM sb""", *V.PREDICTION_BLOCKS, _FEATS, _long_sql(_SLICE_FEATS), _SWEEP, _slice_ttc_sql(), _SLICE_TTC_ERR))
def slice_ttc(spark, d):
    """Combined time-to-collision error on every slice of every feature."""
    out = slice_quantiles.slice_ttc(wide_predictions(spark, d), V.MODELS, _SLICE_FEATS, K.SWEEP_RANGES, _HORIZONS)
    return rounded(out, ["peak_error", "quantile_error", "ttc_error"], 5)


@query("E2", with_blocks(
    "SELECT 'outcome_conditioned' AS kind, q_lo, q_hi, model, samples, round(rmse_x, 4) AS rmse_x FROM sm",
    *V.PREDICTION_BLOCKS, _FEATS,
    "ofe AS (SELECT *, abs(pa * 5e-1 - ax_true) AS oe FROM feats WHERE abs(pa * 5e-1 - ax_true) <= abs(pa * 8e-1 + 3e-1 - ax_true) AND abs(pa * 8e-1 + 3e-1 - ax_true) <= abs(pa - ax_true))",
    "longf AS (SELECT 'all' AS scope, 'ordered_err_x' AS feature, oe AS value, ofe.* FROM ofe)", _SWEEP, _slice_metrics_sql()))
def ordered_slices(spark, d):
    out = slices.ordered_slices(wide_predictions(spark, d), ["damped", "biased", "persistence"], K.SWEEP_RANGES)
    return rounded(out.select("kind", "q_lo", "q_hi", "model", "samples", "rmse_x"), ["rmse_x"], 4)


_RANKED = """
rk AS (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY en, dataset, scene_id, track_id, frame_k) - 1) / greatest(count(*) OVER (PARTITION BY model) - 1, 1) AS error_rank
       FROM (SELECT *, round(sqrt(ex * ex + ey * ey), 6) AS en FROM err))"""
_MIX = ", ".join(f"({g[1]}e0, {t[0]}e0, {t[1]}e0)" for g in K.GOOD_RANK_RANGES for t in K.TAIL_RANK_RANGES)


@query("W11", with_blocks(f"""
SELECT model, good_hi, tail_lo, tail_hi, count(*) AS samples, round(sqrt(avg(ex * ex)), 4) AS rmse_x, round(sqrt(avg(ey * ey)), 4) AS rmse_y
FROM rk, (VALUES {_MIX}) m(good_hi, tail_lo, tail_hi) WHERE error_rank <= good_hi OR (error_rank >= tail_lo AND error_rank <= tail_hi) GROUP BY 1, 2, 3, 4""", *ERROR_BLOCKS, _RANKED))
def stratified_mixes(spark, d):
    p = predicted(spark, d).withColumn("err_norm", F.round("err_norm", 6))
    out = slices.stratified_mixes(slices.error_ranks(p, ["model"], "err_norm"), ["model"])
    return rounded(out, ["rmse_x", "rmse_y"], 4)


R2_WINDOW = (-1.0, 0.5)
_SCREEN_SCORE = "CASE WHEN r2 < -1e0 THEN pow((-1e0 - r2) / 75e-2, 2) WHEN r2 > 5e-1 THEN pow((r2 - 5e-1) / 75e-2, 2) ELSE 5e-2 * pow((r2 + 25e-2) / 75e-2, 2) END"


@query("E4 U4 H11 T2", with_blocks(f"""
SELECT model, samples, round(screen_score, 5) AS screen_score FROM (
  SELECT model, samples, any_value(rset) AS rset, min({_SCREEN_SCORE}) AS screen_score FROM (
    SELECT sm.*, (r2_x + r2_y) / 2 AS r2, rset FROM sm JOIN (
      SELECT scope, feature, q_lo, q_hi, list_sort(list(concat_ws('/', dataset, scene_id, track_id, CAST(frame_k AS VARCHAR)))) AS rset FROM inside GROUP BY 1, 2, 3, 4) USING (scope, feature, q_lo, q_hi))
  WHERE r2 >= -1006e-3 AND r2 <= 506e-3 GROUP BY model, samples, rset)""", *SLICE_BLOCKS))
def screened_slices(spark, d):
    """Cheap screen by R2 against a caller-supplied interval; identical row sets are kept once."""
    out = slices.slice_metrics(wide_predictions(spark, d), V.MODELS, _SLICE_FEATS, K.SWEEP_RANGES)
    return rounded(slices.screen(out, R2_WINDOW).select("model", "samples", "screen_score"), ["screen_score"], 5)


@query("E4 A6", with_blocks("""
SELECT model, samples, round(rmse_x, 4) AS rmse_x, round(rmse_y, 4) AS rmse_y, round(r2, 4) AS r2_mean, round(mmd2, 5) AS mmd2 FROM (
  SELECT model, samples, rset, min(rmse_x) AS rmse_x, min(rmse_y) AS rmse_y, min(r2) AS r2, min(greatest(0, CASE WHEN u < -1e-12 THEN (xx + yy - 2 * xy) / (n * n) ELSE u END)) AS mmd2
  FROM (SELECT sm.*, (r2_x + r2_y) / 2 AS r2 FROM sm) JOIN (
      SELECT scope, feature, q_lo, q_hi, list_sort(list(concat_ws('/', dataset, scene_id, track_id, CAST(frame_k AS VARCHAR)))) AS rset FROM inside GROUP BY 1, 2, 3, 4) USING (scope, feature, q_lo, q_hi)
    JOIN kstat USING (model, scope, feature, q_lo, q_hi)
  WHERE r2 >= -1006e-3 AND r2 <= 506e-3 GROUP BY model, samples, rset)""", *SLICE_BLOCKS, _SLICE_MMD))
def exact_after_screen(spark, d):
    """Exact metrics and discrepancy of every slice of every feature that passes the screen."""
    out = slice_kernels.exact_screened(wide_predictions(spark, d), V.MODELS, _SLICE_FEATS, K.SWEEP_RANGES, R2_WINDOW)
    out = rounded(out, ["rmse_x", "rmse_y", "r2_mean"], 4)
    return rounded(out, ["mmd2"], 5).select("model", "samples", "rmse_x", "rmse_y", "r2_mean", "mmd2")


@query("P28", with_blocks("""
SELECT now.model, round(now.rmse, 5) AS rmse, round(old.p, 5) AS baseline FROM (SELECT model, sqrt(avg(ex * ex)) AS rmse FROM err GROUP BY 1) now
CROSS JOIN (SELECT sqrt(avg(ex * ex)) AS p FROM err WHERE model = 'persistence') old""", *ERROR_BLOCKS))
def previous_results(spark, d):
    """A comparison column looked up from earlier results."""
    now = metrics.regression(predicted(spark, d), ["model"]).select("model", F.col("rmse_x").alias("rmse"))
    old = now.where("model = 'persistence'").select(F.col("rmse").alias("baseline"))
    return rounded(now.crossJoin(F.broadcast(old)), ["rmse", "baseline"], 5)  # one row


# ---- scoring -------------------------------------------------------------------------------------------

@query("X3", with_blocks(
    "SELECT dataset, scene_id, track_id, frame_k, 'persistence' AS model, round(pa, 5) AS ax_pred, round(pb, 5) AS ay_pred FROM base", *V.PREDICTION_BLOCKS))
def plugin_scores(spark, d):
    out = scoring.score(V.kept_windows(spark, d), lambda x: x[:, -1, [1, 3]], "persistence")
    return rounded(out, ["ax_pred", "ay_pred"], 5)


@query("X3")
def linear_baseline(spark, d):
    w = V.kept_windows(spark, d)
    p = scoring.linear(w.where("split = 'train'"), w.where("split <> 'train'"))
    return rounded(metrics.regression(metrics.join_predictions(w, p), ["model", "dataset"]).select("model", "dataset", "samples", "rmse_x", "rmse_y"), ["rmse_x", "rmse_y"], 4)


# ---- long tail -----------------------------------------------------------------------------------------

_PI = "3.141592653589793e0"
_SHAPE = f"""
lg AS (SELECT *, lag(x) OVER t AS px, lag(y) OVER t AS py, lag(heading) OVER t AS ph, row_number() OVER t - 1 AS p FROM tracks WINDOW t AS (PARTITION BY dataset, scene_id, recording, track_id ORDER BY frame)),
turned AS (SELECT *, (heading - ph) - ceil(((heading - ph) - {_PI}) / (2e0 * {_PI})) * (2e0 * {_PI}) AS turn, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS len FROM lg),
shape0 AS (SELECT dataset, scene_id, recording, track_id, count(*) AS n_frames, abs(sum(turn)) AS heading_change_rad, coalesce(sum(len), 0) AS path_len,
   quantile_cont(sqrt(ax * ax + ay * ay), 95e-2) AS acc_p95, max(x) FILTER (p = 11) AS ax0, max(y) FILTER (p = 11) AS ay0, max_by(x, p) - max(x) FILTER (p = 11) AS cx, max_by(y, p) - max(y) FILTER (p = 11) AS cy
   FROM turned GROUP BY 1, 2, 3, 4),
shape AS (SELECT s.*, sqrt(cx * cx + cy * cy) AS net_displacement, (n_frames - 1) * {_DT} AS duration_sec,
   (SELECT max(abs((l.x - ax0) * cy - (l.y - ay0) * cx) / sqrt(cx * cx + cy * cy)) FROM lg l WHERE l.track_id = s.track_id AND l.recording = s.recording AND l.p >= 12) AS max_lateral_deviation FROM shape0 s)"""
_SHAPE_COLS = ["heading_change_rad", "acc_p95", "path_len", "net_displacement", "max_lateral_deviation", "duration_sec"]


def shapes(spark, d):
    return V.landed(spark, d, "shapes", lambda: longtail.track_shape(V.tracks(spark, d)))


@query("L1", with_blocks(
    "SELECT dataset, scene_id, recording, track_id, n_frames, " + ", ".join(f"round({c}, 5) AS {c}" for c in _SHAPE_COLS) + " FROM shape", V.TRACKS_SQL, _SHAPE))
def track_shapes(spark, d):
    return rounded(longtail.track_shape(V.tracks(spark, d)), _SHAPE_COLS, 5)


def _z_sql(c: str) -> str:
    return (f"greatest(-4e0, least(4e0, ({c} - (SELECT quantile_cont({c}, 5e-1) FROM cr)) / (SELECT CASE WHEN quantile_cont({c}, 75e-2) - quantile_cont({c}, 25e-2) >= 1e-9 "
            f"THEN quantile_cont({c}, 75e-2) - quantile_cont({c}, 25e-2) WHEN stddev_pop({c}) >= 1e-9 THEN stddev_pop({c}) ELSE 1e0 END FROM cr)))")


_SCORED = ("cr AS (SELECT *, path_len / greatest(net_displacement, 1e-6) AS curvature_ratio FROM shape)",
           "scored AS (SELECT *, " + " + ".join(f"{w}e0 * {_z_sql(c)}" for c, w in K.LONGTAIL_WEIGHTS.items()) + " AS longtail_score FROM cr)")


def score_rows(spark, d):
    return longtail.scored(shapes(spark, d))


@query("L2 H12", with_blocks(
    "SELECT dataset, scene_id, track_id, round(curvature_ratio, 5) AS curvature_ratio, round(longtail_score, 5) AS longtail_score FROM scored", V.TRACKS_SQL, _SHAPE, *_SCORED))
def longtail_scores(spark, d):
    out = score_rows(spark, d).select("dataset", "scene_id", "track_id", "curvature_ratio", "longtail_score")
    return rounded(out, ["curvature_ratio", "longtail_score"], 5)


@query("L3 T3", with_blocks("""
SELECT dataset, scene_id, track_id, round(longtail_score, 5) AS longtail_score FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY longtail_score DESC, scene_id, track_id) AS k FROM scored s
    WHERE heading_change_rad > 8e-2 OR NOT EXISTS (SELECT 1 FROM scored o WHERE o.dataset = s.dataset AND o.heading_change_rad > 8e-2)) WHERE k <= 8
  ORDER BY longtail_score DESC, scene_id, track_id, dataset LIMIT 12)""", V.TRACKS_SQL, _SHAPE, *_SCORED))
def longtail_cases(spark, d):
    out = longtail.preselect(score_rows(spark, d)).select("dataset", "scene_id", "track_id", "longtail_score")
    return rounded(out, ["longtail_score"], 5)


@query("F14", with_blocks("""
SELECT dataset, scene_id, track_id, n_frames BETWEEN 80 AND 205 AND path_len >= 8 AND abs(duration_sec / 7e0 - 1) <= 3e-1 AND acc_p95 / 1e1 <= 6e-1 AS alignment_accepted FROM shape""", V.TRACKS_SQL, _SHAPE))
def alignment_gate(spark, d):
    from trackloom.operators.cleaning import alignment_gate as gate

    s = shapes(spark, d).withColumns({"length_ratio": F.col("duration_sec") / 7.0, "norm_mean_error": F.col("acc_p95") / 10.0})
    return gate(s, 80, 205, max_mean_error=0.6).select("dataset", "scene_id", "track_id", "alignment_accepted")


_CASES = f"""
cases AS (SELECT concat(dataset, '/', track_id, '/', CAST(segment AS VARCHAR)) AS case_id, step, model, vx_pred, vx, ax_pred, ax FROM rolled WHERE NOT (model = 'damped' AND step % 10 = 0)),
series AS (SELECT case_id, model AS method, step AS frame, vx_pred AS speed, ax_pred AS accel FROM cases UNION ALL SELECT case_id, 'GT', step, vx, ax FROM cases WHERE model = 'biased'),
rks AS (SELECT *, row_number() OVER (PARTITION BY case_id, method ORDER BY frame) - 1 AS rank FROM series)"""


@query("L4", with_blocks("""
SELECT a.case_id, a.method, a.rank, round(abs(a.speed - g.speed), 5) AS speed_error, round(abs(a.accel - g.accel), 5) AS accel_error
FROM rks a JOIN rks g ON a.case_id = g.case_id AND a.rank = g.rank AND g.method = 'GT' WHERE a.method <> 'GT'""", *STEP_BLOCKS, _rollout_sql("semi"), _CASES))
def case_dynamics(spark, d):
    c = rollout(spark, d).where("NOT (model = 'damped' AND step % 10 = 0)").withColumn(
        "case_id", F.concat_ws("/", "dataset", "track_id", F.col("segment").cast("string")))
    cols = lambda m, v, a: [F.col("case_id"), m.alias("method"), F.col("step").alias("frame"), F.col(v).alias("speed"), F.col(a).alias("accel")]
    series = c.select(*cols(F.col("model"), "vx_pred", "ax_pred")).unionByName(
        c.where("model = 'biased'").select(*cols(F.lit("GT"), "vx", "ax")))
    return rounded(longtail.case_dynamics(series), ["speed_error", "accel_error"], 5)


_ABSOLUTE = f"""
spots AS (SELECT s.dataset, s.scene_id, s.track_id, s.segment, t.frame - s.frame_k_start + 11 AS step, t.x, t.y FROM long_segs s JOIN veh t
  ON s.dataset = t.dataset AND s.scene_id = t.scene_id AND s.track_id = t.track_id AND t.frame BETWEEN s.frame_k_start AND s.frame_k_end + 1),
placed2 AS (SELECT r.*, p.x, p.y, a.x + dx_pred AS qx, a.y + dy_pred AS qy FROM rolled r JOIN spots p USING ({_SEG}, step) JOIN (SELECT * FROM spots WHERE step = 11) a USING ({_SEG})),
legs AS (SELECT *, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) AS e, sqrt(pow(qx - lag(qx) OVER t, 2) + pow(qy - lag(qy) OVER t, 2)) AS lp, sqrt(pow(x - lag(x) OVER t, 2) + pow(y - lag(y) OVER t, 2)) AS lt
  FROM placed2 WINDOW t AS (PARTITION BY {_SEG}, model ORDER BY step))""".replace("SELECT r.*, p.x, p.y, a.x + dx_pred", "SELECT r.*, p.x, p.y, a.x + dx_pred")


@query("L5", with_blocks(
    f"SELECT {_SEG}, model, round(avg(e), 4) AS ade_m, round(max_by(e, step), 4) AS fde_m, round(max(e), 4) AS max_error_m, round(sum(lp), 4) AS pred_path_len_m, "
    f"round(sum(lt), 4) AS true_path_len_m, round(sum(lp) / greatest(sum(lt), 1e-9), 4) AS path_ratio FROM legs GROUP BY {_SEG}, model",
    *STEP_BLOCKS, _rollout_sql("semi"), _ABSOLUTE))
def rollout_positions(spark, d):
    segs = trajectories.segment_table(trajectories.split_segments(V.kept_windows(spark, d))).where(F.col("pred_steps") >= MIN_STEPS)
    spots = longtail.positions_in_segments(V.vehicles(spark, d), segs, KEY)
    out = longtail.rollout_against_positions(rollout(spark, d), spots, trajectories.SEGMENT)
    return rounded(out, ["ade_m", "fde_m", "max_error_m", "pred_path_len_m", "true_path_len_m", "path_ratio"], 4)
