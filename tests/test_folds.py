"""Stepwise operators against plain step-by-step loops, with chunks of a few frames."""

import random

import pytest
from pyspark.sql import functions as F

from courtflow.operators import calibration, folds, possession

FRAME_T = 1 / 30.0


def boxes(spark, seed, matches=6, frames=40, drop=0.15, spread=60.0):
    rng = random.Random(seed)
    data = []
    for m in range(matches):
        people = [[rng.uniform(0, spread), rng.uniform(0, spread)] for _ in range(4)]
        f = 0
        for _ in range(frames):
            no = 1
            for p in people:
                p[0] += rng.uniform(-6, 6)
                p[1] += rng.uniform(-6, 6)
                if rng.random() > drop:
                    w, h = rng.uniform(18, 40), rng.uniform(18, 60)
                    data.append((m, f, no, "player", p[0], p[1], p[0] + w, p[1] + h, round(rng.random(), 2)))
                    no += 1
            f += rng.choice([1, 1, 1, 2])
    schema = "match_id long, frame_number long, det_no long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double"
    return spark.createDataFrame(data, schema).cache()


def by_match_frame(df, *cols):
    out = {}
    for r in df.orderBy("match_id", "frame_number", "det_no").collect():
        out.setdefault(r.match_id, {}).setdefault(r.frame_number, []).append(tuple(r[c] for c in cols))
    return out


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


@pytest.mark.parametrize("size", [10, 1000])
def test_tracker(spark, size):
    df = boxes(spark, 3)
    want = {}
    for m, frames in by_match_frame(df, "det_no", "x1", "y1", "x2", "y2").items():
        live, next_id = {}, 1
        for f, dets in frames.items():
            for t in live.values():
                t["age"] += 1
            free, fresh = sorted(live), []
            for no, *box in dets:
                scored = [(overlap(live[i]["box"], box), -i) for i in free]
                best = max(scored, default=(0, 0))
                if best[0] > 0.3:
                    i = -best[1]
                    live[i] = {"box": box, "age": 0}
                    free.remove(i)
                    want[m, f, no] = i
                else:
                    fresh.append((no, box))
            for no, box in fresh:
                live[next_id] = {"box": box, "age": 0}
                want[m, f, no] = next_id
                next_id += 1
            live = {i: t for i, t in live.items() if t["age"] <= 3}
    got = folds.iou_tracker(df, max_age=3, size=size).collect()
    assert {(r.match_id, r.frame_number, r.det_no): r.track_id for r in got} == want
    assert max(want.values()) > 5


@pytest.mark.parametrize("size", [4, 1000])
def test_tracks_age_on_frames_without_detections(spark, size):
    box = "1 AS det_no, 0D AS x1, 0D AS y1, 10D AS x2, 10D AS y2"
    df = spark.sql(f"SELECT m AS match_id, f AS frame_number, {box} FROM VALUES (0L, 0L), (0L, 25L), (0L, 52L), (1L, 3L), (1L, 29L) t(m, f)")
    frames = spark.sql("SELECT m AS match_id, f AS frame_number FROM (SELECT explode(array(0L, 1L)) AS m), (SELECT explode(sequence(0L, 60L)) AS f)")
    got = {(r.match_id, r.frame_number): r.track_id for r in folds.iou_tracker(df, frames, size=size).collect()}
    # unseen for 24, 26 and 25 frames: gone once the age is above 25
    assert got == {(0, 0): 1, (0, 25): 1, (0, 52): 2, (1, 3): 1, (1, 29): 1}


def test_tracks_meet_only_small_tables(spark):
    """Every detection is one row, also those that share a number, and rows are not shuffled after the fold."""
    box = "0D AS x1, 0D AS y1, 10D AS x2, 10D AS y2"
    df = spark.sql(f"SELECT 0L AS match_id, f AS frame_number, n AS det_no, {box} FROM VALUES (0L, 1L), (0L, 1L), (1L, 1L), (40L, 1L), (80L, null), (null, 1L) t(f, n)")
    got = folds.iou_tracker(df, size=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    rows = sorted((-1 if r.frame_number is None else r.frame_number, r.track_id or 0) for r in got.collect())
    assert rows == [(-1, 0), (0, 1), (0, 2), (1, 1), (40, 1), (80, 0)]


@pytest.mark.parametrize("size", [10, 1000])
def test_stabiliser(spark, size):
    df = boxes(spark, 4, drop=0.05)
    want = {}
    for m, frames in by_match_frame(df, "det_no", "confidence", "x1", "y1", "x2", "y2").items():
        history = []
        for f, dets in frames.items():
            now, used = [], set()
            new = []
            for no, conf, *box in dets:
                if conf < 0.1:
                    continue
                options = [(overlap(box, h["box"]), -j) for j, h in enumerate(history) if j not in used]
                score, j = max(options, default=(0, 0))
                if score <= 0.3:
                    new.append({"no": no, "box": box, "conf": conf, "n": 0, "st": 0.0})
                    continue
                h = history[-j]
                used.add(-j)
                move = (((box[0] + box[2]) - (h["box"][0] + h["box"][2])) ** 2 / 4 + ((box[1] + box[3]) - (h["box"][1] + h["box"][3])) ** 2 / 4) ** 0.5
                size_of = lambda b: (b[2] - b[0]) * (b[3] - b[1])
                if move < 3 or size_of(box) / size_of(h["box"]) > 1.5:
                    box = h["box"]
                st = overlap(h["box"], box) * 0.5 + (1 - abs(h["conf"] - conf)) * 0.3 + min(1, h["n"] / 10) * 0.2
                if h["n"] + 1 >= 2:
                    box = [0.6 * a + 0.4 * b for a, b in zip(h["box"], box)]
                now.append({"no": no, "box": box, "conf": max(h["conf"] * 0.95, conf), "n": h["n"] + 1, "st": st})
            history = now + new
            for d in history:
                want[m, f, d["no"]] = (*d["box"], d["conf"], d["n"], d["st"], d["st"] >= 0.5 or d["n"] < 2)
    got = {
        (r.match_id, r.frame_number, r.det_no): (r.x1, r.y1, r.x2, r.y2, r.confidence, r.frames_seen, r.stability, r.kept)
        for r in folds.stabilize_bboxes(df, size=size).collect()
    }
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def ball_rows(spark, seed, matches=8, frames=60):
    rng = random.Random(seed)
    data = []
    for m in range(matches):
        holder = None
        for f in range(frames):
            if rng.random() < 0.3:
                holder = rng.choice([None, None, 0, 1, 2, 3])
            team = rng.choice(["home", "away", None]) if holder else None
            data.append((m, f, f * rng.choice([0.1]), holder, team))
    return spark.createDataFrame(data, "match_id long, frame_number long, ts_sec double, possession_player_id long, team string").cache()


def fsm(rows, limit):
    state, start, who, team, out = "NO", None, None, None, []
    for f, t, p, pteam in rows:
        def emit(kind, player):
            out.append((f, kind, player, team or "home"))
        if state == "NO":
            if p:
                state, start, who, team = "START", t, p, pteam or team
                emit("gained", p)
        elif state == "START":
            state = "HELD"
        elif state == "HELD":
            if not p:
                state = "OVER"
                emit("lost", who)
            elif p != who:
                team = pteam or team
                emit("lost", who)
                who = p
                emit("gained", p)
            elif start and t - start > limit:
                state = "OVER"
                emit("timeout", who)
        else:
            state, start, who, team = "NO", None, None, None
    return out


@pytest.mark.parametrize("size", [6, 1000])
def test_possession_fsm(spark, size):
    df = ball_rows(spark, 9)
    want = {}
    for r in df.orderBy("match_id", "frame_number").collect():
        want.setdefault(r.match_id, []).append((r.frame_number, r.ts_sec, r.possession_player_id, r.team))
    want = {m: fsm(rows, 1.0) for m, rows in want.items()}
    got = {}
    for r in folds.possession_fsm(df, timeout=1.0, size=size).orderBy("match_id", "frame_number", "event_no").collect():
        got.setdefault(r.match_id, []).append((r.frame_number, r.event_type, r.player_id, r.team))
    assert got == {m: e for m, e in want.items() if e}
    assert {e[1] for es in want.values() for e in es} == {"gained", "lost", "timeout"}


def test_fsm_traces(spark):
    """The documented cases: gained, held, transfer, timeout after four seconds, lost."""

    def run(*rows):
        data = [(1, i, float(t), p, team) for i, (t, p, team) in enumerate(rows)]
        df = spark.createDataFrame(data, "match_id long, frame_number long, ts_sec double, possession_player_id long, team string")
        out = folds.possession_fsm(df).orderBy("frame_number", "event_no").collect()
        return [(r.frame_number, r.event_type, r.player_id, r.team) for r in out]

    assert run((1, 1, "home")) == [(0, "gained", 1, "home")]
    assert run((1, 1, "home"), (2, 1, "home")) == [(0, "gained", 1, "home")]
    assert run((1, 1, "home"), (2, 1, "home"), (3, 2, "away")) == [
        (0, "gained", 1, "home"), (2, "lost", 1, "away"), (2, "gained", 2, "away")]
    assert run((1, 1, "home"), (2, 1, "home"), (5, 1, "home"))[-1] == (2, "timeout", 1, "home")
    assert run((1, 1, "home"), (2, 1, "home"), (3, None, None), (4, 1, "home"), (5, 1, None)) == [
        (0, "gained", 1, "home"), (2, "lost", 1, "home"), (4, "gained", 1, "home")]
    assert run((1, None, None), (2, 0, None)) == []
    assert run((0, 1, "home"), (1, 1, "home"), (9, 1, "home")) == [(0, "gained", 1, "home")]  # start time 0 never expires


def test_kalman_takes_two_passes_over_any_number_of_chunks(spark, monkeypatch):
    cut, written = folds.cut_lineage, []
    monkeypatch.setattr(folds, "cut_lineage", lambda df, label="table": written.append(label) or cut(df, label))
    rng = random.Random(5)
    data = [(1, f, rng.uniform(0, 50), rng.uniform(0, 50)) for f in range(600)]
    points = spark.createDataFrame(data, "match_id long, frame_number long, x double, y double")
    whole, cuts = (
        {r.frame_number: tuple(r)[2:] for r in folds.kalman_ball(points, points, size=size).select("match_id", "frame_number", "x", "y", "vx", "vy").collect()}
        for size in (1000, 50)
    )
    assert len(written) == 4  # twelve rounds before, each with tables of its own
    assert len(cuts) == 600 and all(cuts[f] == pytest.approx(whole[f], abs=1e-7) for f in whole)


@pytest.mark.parametrize("layout", ["block", "state"])
def test_kalman(spark, layout):
    import numpy as np

    rng = random.Random(2)
    data = [(m, f, rng.uniform(0, 50) if rng.random() > 0.3 else None) for m in range(4) for f in range(50)]
    frames = spark.createDataFrame([(m, f) for m, f, _ in data], "match_id long, frame_number long")
    points = spark.createDataFrame(
        [(m, f, x, 2 * x) for m, f, x in data if x is not None], "match_id long, frame_number long, x double, y double"
    )
    big = folds.kalman_ball(points, frames, layout=layout)
    small = folds.kalman_ball(points, frames, layout=layout, size=20)
    key = lambda r: (r.match_id, r.frame_number)
    a, b = ({key(r): tuple(r)[2:] for r in d.select("match_id", "frame_number", "x", "y", "vx", "vy", "measured").collect()} for d in (big, small))
    assert a == b
    dt, q0 = 1 / 30, 0.1
    f = np.eye(4)
    f[0, 2] = f[1, 3] = dt
    h = np.eye(4)[:2]
    bl = q0 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
    q = np.zeros((4, 4))
    order = [0, 1, 2, 3] if layout == "block" else [0, 2, 1, 3]
    q[np.ix_(order[:2], order[:2])] = bl
    q[np.ix_(order[2:], order[2:])] = bl
    for m in range(4):
        x = p = None
        for mm, fr, z in data:
            if mm != m:
                continue
            if x is None:
                if z is None:
                    assert (m, fr) not in a
                    continue
                x, p = np.array([z, 2 * z, 0, 0]), 1000 * np.eye(4)
            else:
                x, p = f @ x, f @ p @ f.T + q
                if z is not None:
                    k = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.eye(2))
                    x = x + k @ (np.array([z, 2 * z]) - h @ x)
                    p = (np.eye(4) - k @ h) @ p
            assert a[m, fr][:4] == pytest.approx(tuple(x), abs=1e-6)


def test_predict_round(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 0.0, 30.0, 60.0)], "match_id long, frame_number long, x double, y double, vx double, vy double")
    got = [(r.step, round(r.x, 9), round(r.y, 9)) for r in folds.predict_trajectory(d, 3).orderBy("step").collect()]
    assert got == [(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 6.0)]


@pytest.mark.parametrize("interval,check", [(60, 30), (30, 30), (45, 10)])
def test_recalibration(spark, interval, check):
    rng = random.Random(1)
    data = [(m, f, rng.choice([0, 1, 2]), rng.choice([5.0, 30.0, 40.0])) for m in range(3) for f in range(0, 3000, 5)]
    df = spark.createDataFrame(data, "match_id long, frame_number long, hoops long, drift_px double")
    want, last = set(), {}
    for m, f, hoops, px in data:
        if f % check == 0 and hoops >= 1 and px > 20 and f - last.get(m, -10**6) >= interval:
            last[m] = f
            want.add((m, f))
    got = calibration.auto_recalibrate(df, check, interval, size=512)
    assert {(r.match_id, r.frame_number) for r in got.collect()} == want


def test_nms(spark):
    df = boxes(spark, 7, matches=3, spread=30.0)
    want = set()
    for m, frames in by_match_frame(df, "confidence", "det_no", "x1", "y1", "x2", "y2").items():
        for f, dets in frames.items():
            kept = []
            for conf, no, *box in sorted(dets, key=lambda d: (-d[0], d[1])):
                if conf > 0.1 and all(overlap(box, k) <= 0.4 for k in kept):
                    kept.append(box)
                    want.add((m, f, no))
    once = folds.nms(df)
    got = {(r.match_id, r.frame_number, r.det_no) for r in once.collect()}
    assert got == want and len(want) < df.count()
    again = folds.nms(once.join(df.select("match_id", "frame_number", "det_no", "confidence"), ["match_id", "frame_number", "det_no"]))
    assert again.count() == len(want)


def test_nms_shuffles_plain_rows(spark):
    """Lists are made behind the only exchange, not on both sides of it."""
    plan = folds.nms(boxes(spark, 7, matches=3, spread=30.0))._jdf.queryExecution().sparkPlan().toString()
    below = plan.split("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange", 1)
    assert len(below) == 2 and "collect_list" in below[0] and "collect_list" not in below[1]


def test_shrink(spark):
    import statistics

    df = boxes(spark, 11, matches=3, spread=30.0)
    want = {}
    for m, frames in by_match_frame(df, "det_no", "x1", "y1", "x2", "y2").items():
        for f, dets in frames.items():
            bs = [list(b) for _, *b in dets]
            med = statistics.median(b[2] - b[0] for b in bs)
            for i in range(len(bs)):
                a, hits = bs[i], 0
                for j, o in enumerate(bs):
                    w, h = min(a[2], o[2]) - max(a[0], o[0]), min(a[3], o[3]) - max(a[1], o[1])
                    if i != j and w > 0 and h > 0 and w * h / ((a[2] - a[0]) * (a[3] - a[1])) > 0.1:
                        hits += 1
                if len(bs) > 1 and (hits >= 2 or a[2] - a[0] > 1.6 * med):
                    w, h = a[2] - a[0], a[3] - a[1]
                    bs[i] = [a[0] + w * 0.2, a[1] + h * 0.1, a[2] - w * 0.2, a[3] - h * 0.1]
                want[m, f, dets[i][0]] = tuple(bs[i])
    got = {(r.match_id, r.frame_number, r.det_no): (r.x1, r.y1, r.x2, r.y2) for r in folds.shrink_oversized_players(df, size=8).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def smooth_by_steps(values, k):
    current, pending, count, out = None, None, 0, []
    for v in values:
        if current is None:
            current = v
        elif v != current:
            if pending is None or pending != v:
                pending, count = v, 1
            else:
                count += 1
            if count >= k:
                current, pending, count = pending, None, 0
        else:
            pending, count = None, 0
        out.append(current)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 4])
@pytest.mark.parametrize("size", [3, 1000])
def test_smoothing_and_episodes(spark, k, size):
    rng = random.Random(k)
    series = {}
    for m in range(25):
        v, row = None, []
        for _ in range(rng.choice([1, 4, 50])):
            if rng.random() < 0.4:
                v = rng.choice([None, 1, 2, 3])
            row.append(v)
        series[m] = row
    data = [(m, f, f * 0.5, v, 0.1 * f if v else 0.0) for m, row in series.items() for f, v in enumerate(row)]
    raw = spark.createDataFrame(data, "match_id long, frame_number long, ts_sec double, raw_player long, raw_confidence double")
    smoothed = possession.smooth_possession(raw, k=k, size=size)
    got = {}
    for r in smoothed.orderBy("match_id", "frame_number").collect():
        got.setdefault(r.match_id, []).append(r.smoothed)
    want = {m: smooth_by_steps(row, k) for m, row in series.items()}
    assert got == want

    episodes, late = set(), set()
    for m, row in want.items():
        who = start = None
        told = False
        for f, v in enumerate(row):
            if v != who:
                if who is not None:
                    episodes.add((m, who, start, f))
                who, start, told = v, f, False
            if who is not None and not told and (f - start) * 0.5 > 3.0:
                late.add((m, who, start, f))
                told = True
        if who is not None:
            episodes.add((m, who, start, len(row) - 1))
    got = possession.possession_changes(smoothed, size)
    assert {(r.match_id, r.player_id, r.start_frame, r.end_frame) for r in got.collect()} == episodes
    got = possession.three_second_violations(smoothed, size=size)
    assert {(r.match_id, r.player_id, r.start_frame, r.violation_frame) for r in got.collect()} == late

    averaged = {}
    for m, row in series.items():
        s, on = 0.0, False
        for f, v in enumerate(row):
            c = 0.1 * f if v else 0.0
            s = 0.7 * c + (1 - 0.7) * s if on else c
            on = on or v is not None
            averaged[m, f] = s
    got = possession.smooth_confidence(raw, size=size)
    for r in got.collect():
        assert r.smoothed_confidence == pytest.approx(averaged[r.match_id, r.frame_number], abs=1e-12)
