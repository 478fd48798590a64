"""The landed rollout carries what its readers use and nothing else through its joins and sums."""

from trackloom.plans import metric_queries as M, views as V


def test_no_unused_columns(spark, monkeypatch):
    monkeypatch.setattr(V, "landed", lambda spark, folder, name, build: build())
    got = set(M.rollout(spark, "/root/testdata/sf0.001").columns)
    assert not got & {"prev_vx", "prev_ax", "prev_vy", "prev_ay", "pred_steps", "features"}
    assert {"frame_k_start", "frame_k_end", "windows", "model", "step", "dt", "err", "vx", "ax", "vy", "ay", "ax_pred", "ay_pred", "dx_true", "dy_true"} <= got
