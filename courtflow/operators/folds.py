"""Rules whose next step depends on everything before it.

A match is not handed to one task. It is cut into chunks of frames, a chunk into pieces. Every
chunk is folded at once from an empty state, and the state after each piece is logged. A chunk whose
true entry state (the exit state of the chunk before) turns out different is folded again, but only
up to the piece after which its state equals the logged one: from there on all went as before.
The possession automaton, the stabiliser and the tracker forget their past, so states meet soon; the
result is exact however long it takes. The ball filter need not forget, but is linear: it is a scan. Each round settles at least the first
unsettled chunk of every match, so there are never more rounds than a match has chunks. Chunk
results are tables in the shared folder, so a lost executor costs one task.

A null match (or class) is a group of its own. Rows without frame number have no place in an order,
so they are not folded: the operators leave them out of events and boxes, and give them null track ids.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from courtflow.functions import geometry as G
from courtflow.functions.geometry import BOX
from courtflow.operators.ordered import CHUNK_FRAMES, add_chunk, running_sum
from courtflow.session import cut_lineage, scratch_path

# executors get the step functions by value; they need no copy of this package, so
# those functions name no other module of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME = ["match_id", "frame_number"]
_CHUNK = "__chunk"
_ID, _PIECE = "__id", "__piece_no"
#: Pieces of a chunk.
PIECES = 16
#: Frames that one call of Python folds, at least: as many chunks as these hold, one after the other.
_CALL, CALL_FRAMES = "__call", CHUNK_FRAMES


def with_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add a text that names the group; nulls are left out of it, so it is never null."""
    return df.withColumn(_ID, F.to_json(F.struct(*keys)))


def chunked_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable,
    out_schema: str,
    size: int = CHUNK_FRAMES,
) -> tuple[DataFrame, DataFrame]:
    """``step(rows, state) -> (out_rows, new_state, note)`` over each group's rows in
    order; out_rows are tuples of ``out_schema``, states and notes are JSON-able, and step may be
    called for any run of whole frames. Short chunks share a task's call, each folded by itself.
    Returns the output rows (with keys, group and piece) and one row per piece with its note.
    Pieces are numbered in order of frames. Rows without ``order[0]`` are not folded."""
    keys, order = list(keys), list(order)
    by = [_ID, _PIECE]
    spark = df.sparkSession
    length = max(1, size // PIECES)
    d = add_chunk(with_group(df.filter(F.col(order[0]).isNotNull()), keys), order[0], size)
    within = F.floor((F.col(order[0]) - F.col(_CHUNK) * size) / length).cast("long")
    call = F.floor(F.col(_CHUNK) / F.lit(max(1, CALL_FRAMES // size))).cast("long")
    d = d.withColumns({_PIECE: F.col(_CHUNK) * 2 * PIECES + within, _CALL: call}).drop(_CHUNK)
    data = cut_lineage(d, "fold-input")

    out_fields = T.StructType.fromDDL(out_schema).fields
    logged = [T.StructField(c, T.StringType()) for c in ("__entry", "__exit", "__note")]
    own = [T.StructField(_ID, T.StringType()), T.StructField(_CALL, T.LongType()), T.StructField(_PIECE, T.LongType())]
    schema = T.StructType([*own, *[d.schema[k] for k in keys], *out_fields, *logged])
    types, names = to_arrow_schema(schema), [f.name for f in out_fields]

    def run(rows, known):
        """``known``: the pieces to fold, with entry state and logged exit, or None for all of them: a chunk's
        first piece then has no state. The piece behind a changed one is folded from where that ended."""
        if not rows.num_rows or known is not None and not known.num_rows:
            return types.empty_table()
        constant = {c: rows.column(c)[0] for c in [_ID, _CALL, *keys]}
        rows = rows.to_pandas()
        # whole frames in order, nulls last
        rows = rows.iloc[np.lexsort([rows[c].to_numpy() for c in reversed([_PIECE, *order])])]
        number = rows[_PIECE].to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        log = {} if known is None else {r[_PIECE]: r for r in known.to_pylist()}
        made, places, ends = [], [], []
        last, text, changed = None, None, False  # the piece folded last, its exit, and whether that is new
        for x, y in zip(cut, cut[1:]):
            at = int(number[x])
            if known is None:
                start = text if last is not None and last // (2 * PIECES) == at // (2 * PIECES) else None
            elif changed and log[at]["__before"] == last:
                start = text
            elif log[at]["__todo"]:
                start = log[at]["__want"]
            else:
                continue
            out, state, note = step(rows.iloc[x:y], None if start is None else json.loads(start))
            last, text = at, json.dumps(state)
            changed = known is not None and log[at]["__exit"] != text
            made += out
            places += [at] * len(out)
            ends.append((at, start, text, json.dumps(note)))
        n, m = len(made), len(ends)
        columns = {c: pa.repeat(v, n + m) for c, v in constant.items()}
        columns[_PIECE] = pa.array(places + [e[0] for e in ends], pa.int64())
        for c, values in zip(names, zip(*made) if made else [()] * len(names)):
            columns[c] = pa.array([*values, *[None] * m], types.field(c).type, from_pandas=True)
        for i, c in enumerate(("__entry", "__exit", "__note"), 1):
            columns[c] = pa.array([None] * n + [e[i] for e in ends], pa.string())
        return pa.Table.from_arrays([columns[c] for c in types.names], schema=types)

    pieces = None  # the latest fold of every piece
    rounds: list[DataFrame] = []
    reach = 1
    while True:
        n = len(rounds)
        path = scratch_path(spark, "fold-round")
        if n:
            # small beside the rows, so the few rows wanted are picked where they lie
            chosen = cut_lineage(known.filter("__chosen").select(*by), "fold-chosen")
            part = data.join(chosen, by, "left_semi").groupBy(_ID, _CALL)
            calls = known.filter("__chosen").groupBy(_ID, _CALL)
            made = part.cogroup(calls).applyInArrow(run, schema)
        else:
            made = data.groupBy(_ID, _CALL).applyInArrow(lambda rows: run(rows, None), schema)
        made.write.parquet(path)
        done = spark.read.schema(schema).parquet(path)
        rounds.append(done.filter(F.col("__exit").isNull()).select(_ID, _PIECE, *keys, *names))
        now = done.filter(F.col("__exit").isNotNull()).select(*by, _CALL, "__entry", "__exit", "__note", F.lit(n).alias("__round"))
        if pieces is not None:
            now = pieces.join(now.select(*by), by, "left_anti").unionByName(now)
        pieces = cut_lineage(now, "fold-pieces")
        ordered = Window.partitionBy(_ID).orderBy(_PIECE)
        known = pieces.withColumns({"__want": F.lag("__exit").over(ordered), "__before": F.lag(_PIECE).over(ordered)})
        known = known.withColumn("__todo", ~F.col("__entry").eqNullSafe(F.col("__want")))
        known = known.withColumn("__chosen", F.max("__todo").over(ordered.rowsBetween(1 - reach, 0)))
        known = cut_lineage(known.drop("__note", "__round"), "fold-known")
        if known.filter("__todo").isEmpty():
            break
        reach *= 2
    out = rounds[0]
    if n:
        out = out.join(cut_lineage(pieces.filter("__round > 0").select(*by), "fold-changed"), by, "left_anti")
    for i, rows in enumerate(rounds[1:], 1):
        out = out.unionByName(rows.join(pieces.filter(F.col("__round") == i).select(*by), by, "left_semi"))
    return out, pieces.select(*by, "__note")


# -- possession automaton -------------------------------------------------------------


def _fsm(timeout: float):
    def step(rows, state):
        phase, start, player, team = state or ["none", None, None, None]
        out = []
        for frame, ts, holder, holder_team in zip(
            rows["frame_number"], rows["ts_sec"], rows["possession_player_id"], rows["team"]
        ):
            has = holder is not None and not pd.isna(holder) and int(holder) != 0
            holder = int(holder) if has else None
            known = isinstance(holder_team, str)
            emit = lambda kind, who: out.append((frame, len(out), ts, who, team or "home", kind))
            if phase == "none":
                if has:
                    phase, start, player = "start", float(ts), holder
                    team = holder_team if known else team
                    emit("gained", holder)
            elif phase == "start":
                phase = "held"
            elif phase == "held":
                if not has:
                    phase = "ended"
                    emit("lost", player)
                elif holder != player:
                    old, player = player, holder
                    team = holder_team if known else team
                    emit("lost", old)
                    emit("gained", holder)
                elif start and ts - start > timeout:
                    phase = "ended"
                    emit("timeout", player)
            else:
                phase, start, player, team = "none", None, None, None
        return out, [phase, start, player, team], None

    return step


def possession_fsm(frames: DataFrame, timeout: float = 3.0, size: int = CHUNK_FRAMES) -> DataFrame:
    """Gained / lost / timeout events. ``frames``: match_id, frame_number, ts_sec,
    possession_player_id (null or 0 for none), team (of that player, if seen)."""
    d = frames.select(*FRAME, "ts_sec", F.col("possession_player_id").cast("double"), "team")
    schema = "frame_number long, event_no long, ts_sec double, player_id long, team string, event_type string"
    out, _ = chunked_fold(d, ["match_id"], ["frame_number"], _fsm(timeout), schema, size)
    return out.drop(_ID, _PIECE)


# -- tracker ---------------------------------------------------------------------------


def _by_frame(rows, columns):
    """(frame, list of row tuples) in frame order, without a pandas group per frame."""
    frames = rows["frame_number"].to_numpy()
    cut = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
    records = list(zip(*[rows[c].tolist() for c in columns]))
    for a, b in zip(cut, cut[1:]):
        yield int(frames[a]), records[a:b]


def _overlap(a, b) -> float:
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def _tracker(max_age: int, threshold: float):
    """Tracks are known by where they came from: a slot of the entry state or their number
    among those opened by the same call. So states compare equal whatever the ids are."""

    def step(rows, state):
        rows = rows.astype({"det_no": "float64"})
        tracks = [[list(box), age, ["slot", i]] for i, (box, age) in enumerate(state or [])]
        out, made = [], 0
        for frame, group in _by_frame(rows, ["det_no", *BOX]):
            for t in tracks:
                t[1] += 1
            free, opened = list(tracks), []
            for no, *box in group:
                if no != no:  # a frame without detections
                    continue
                best, best_iou = None, threshold
                for t in free:
                    score = _overlap(t[0], box)
                    if score > best_iou:
                        best, best_iou = t, score
                if best is None:
                    best = [box, 0, ["new", made]]
                    opened.append(best)
                    made += 1
                else:
                    best[0], best[1] = box, 0
                    free = [t for t in free if t is not best]
                kind, i = best[2]
                out.append((frame, int(no), kind == "slot", i))
            tracks = [t for t in tracks + opened if t[1] <= max_age]
        return out, [[t[0], t[1]] for t in tracks], [made, [t[2] for t in tracks]]

    return step


def iou_tracker(
    detections: DataFrame,
    frames: DataFrame | None = None,
    max_age: int = 25,
    threshold: float = 0.3,
    size: int = CHUNK_FRAMES,
) -> DataFrame:
    """Track ids (from 1 in order of appearance) by greedy overlap; a track ends
    after ``max_age`` processed frames unseen. ``frames`` (match_id, frame_number) are
    the frames processed, with detections or not; without it, those with detections.
    Detections without frame number or det_no have a null track id."""
    d = detections.select(*FRAME, "det_no", *BOX)
    if frames is not None:  # a row without box for each frame, which opens and ends nothing
        listed = frames.select(*FRAME)
        d = d.unionByName(listed, allowMissingColumns=True)
    out, notes = chunked_fold(
        d, ["match_id"], ["frame_number", "det_no"], _tracker(max_age, threshold), "frame_number long, det_no long, old boolean, place long", size
    )

    def resolve(pdf):  # one small row per piece: the number of tracks before it, and the ids in its entry slots
        rows, slots, before = [], [], 0
        for m, c, note in pdf.sort_values(_PIECE)[[_ID, _PIECE, "__note"]].itertuples(index=False):
            rows.append((m, c, before, slots))
            made, kept = json.loads(note)
            slots = [slots[i] if kind == "slot" else before + i + 1 for kind, i in kept]
            before += made
        return pd.DataFrame(rows, columns=[_ID, _PIECE, "before", "slots"])

    entry = notes.groupBy(_ID).applyInPandas(resolve, f"{_ID} string, {_PIECE} long, before long, slots array<long>")
    entry = cut_lineage(entry, "track-slots")
    track = F.when(F.col("old"), F.get("slots", F.col("place").cast("int"))).otherwise(F.col("before") + F.col("place") + 1)
    tracked = out.join(entry, [_ID, _PIECE]).select(*FRAME, "det_no", track.alias("track_id"))
    unplaced = detections.filter(F.col("frame_number").isNull() | F.col("det_no").isNull())
    return tracked.unionByName(unplaced.select(*FRAME, "det_no", F.lit(None).cast("long").alias("track_id")))


def match_tracks(detections: DataFrame, tracks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Detections with the track box of their frame that overlaps most (at least
    ``threshold``); several detections may share a track. ``tracks``: match_id,
    frame_number, track_id and box."""
    t = tracks.select(*FRAME, "track_id", *[F.col(c).alias("t_" + c) for c in BOX])
    near = detections.select(*FRAME, "det_no", *BOX).join(t, FRAME)
    near = near.withColumn("iou", G.iou(G.box(), G.box("t_"))).filter((F.col("iou") >= threshold) & (F.col("iou") > 0))
    best = near.groupBy(*FRAME, "det_no").agg(
        F.max_by(F.struct("track_id", "iou"), F.struct("iou", -F.col("track_id"))).alias("b")
    )
    return detections.select(*FRAME, "det_no").join(best, [*FRAME, "det_no"], "left").select(
        *FRAME, "det_no", F.col("b.track_id").alias("track_id"), F.col("b.iou").alias("iou")
    )


# -- box stabiliser ---------------------------------------------------------------------


def _stabiliser(p: dict):
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])

    def step(rows, state):
        # history entries: box, confidence, frames seen, stability, first frame, first det_no
        history = state or []
        out = []
        for frame, group in _by_frame(rows, [*BOX, "confidence", "det_no"]):
            seen = [([a, b, c, d], conf, no) for a, b, c, d, conf, no in group if conf >= p["min_confidence"]]
            taken, matched, fresh = set(), [], []
            for box, conf, no in seen:
                best, best_iou = None, 0.0
                for j, h in enumerate(history):
                    if j in taken:
                        continue
                    score = _overlap(box, h[0])
                    if score > best_iou and score > p["iou"]:
                        best, best_iou = j, score
                if best is None:
                    fresh.append(([box, conf, 0, 0.0, frame, no], no))
                    continue
                taken.add(best)
                hbox, hconf, n, _, first, first_no = history[best]
                dx = (box[0] + box[2] - hbox[0] - hbox[2]) / 2.0
                dy = (box[1] + box[3] - hbox[1] - hbox[3]) / 2.0
                if math.sqrt(dx * dx + dy * dy) < p["min_motion"]:
                    box = hbox
                if area(hbox) > 0 and area(box) / area(hbox) > p["max_growth"]:
                    box = hbox
                stability = (
                    _overlap(hbox, box) * 0.5 + max(0.0, 1 - abs(hconf - conf)) * 0.3 + min(1.0, n / 10.0) * 0.2
                )
                new = [box, max(hconf * 0.95, conf), n + 1, stability, first, first_no]
                if n + 1 >= p["min_frames"]:
                    new[0] = [p["alpha"] * h + (1 - p["alpha"]) * c for h, c in zip(hbox, box)]
                matched.append((new, no))
            history = []
            for new, no in matched + fresh:
                history.append(new)
                kept = new[3] >= 0.5 or new[2] < p["min_frames"]
                out.append((frame, no, *new[0], new[1], new[2], new[3], new[4], new[5], kept))
        return out, history, None

    return step


def stabilize_bboxes(
    detections: DataFrame,
    iou: float = 0.3,
    min_confidence: float = 0.1,
    min_frames: int = 2,
    min_motion: float = 3.0,
    max_growth: float = 1.5,
    alpha: float = 0.6,
    size: int = CHUNK_FRAMES,
) -> DataFrame:
    """Boxes matched to the frame before and smoothed; ``kept`` marks those stable
    enough to report. A detection is known by the one that opened its history."""
    p = {"iou": iou, "min_confidence": min_confidence, "min_frames": min_frames, "min_motion": min_motion,
         "max_growth": max_growth, "alpha": alpha}
    d = detections.select(*FRAME, "class_name", "det_no", *BOX, "confidence")
    schema = (
        "frame_number long, det_no long, x1 double, y1 double, x2 double, y2 double, confidence double, "
        "frames_seen long, stability double, first_frame long, first_no long, kept boolean"
    )
    keys = ["match_id", "class_name"]
    out, _ = chunked_fold(d, keys, ["frame_number", "det_no"], _stabiliser(p), schema, size)
    return out.drop(_ID, _PIECE)


def stabiliser_statistics(stabilized: DataFrame, detections: DataFrame) -> DataFrame:
    """State of the stabiliser after each class's last frame of input (``detections``), which
    may have left it without any box."""
    keys = ["match_id", "class_name"]
    last = detections.groupBy(*keys).agg(F.max("frame_number").alias("frame_number"))
    last = cut_lineage(last, "last-frames")  # of known size, so boxes need not be shuffled to meet it
    d = stabilized.join(last, [*keys, "frame_number"])
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("stability").alias("avg_stability"),
        F.avg("frames_seen").alias("avg_frames_seen"),
        F.avg("confidence").alias("avg_confidence"),
    )


# -- ball filter -------------------------------------------------------------------------


def _constant_velocity(dt: float, process: float, measurement: float, layout: str):
    """Transition, observation and their noise."""
    f = np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1]], dtype=float)
    h = np.array([[1, 0, 0, 0], [0, 1, 0, 0]], dtype=float)
    block = np.array([[0.25 * dt**4, 0.5 * dt**3], [0.5 * dt**3, dt**2]]) * process
    q = np.zeros((4, 4))
    for pos, vel in ((0, 1), (2, 3)) if layout == "block" else ((0, 2), (1, 3)):
        q[np.ix_([pos, vel], [pos, vel])] = block
    return f, h, q, np.eye(2) * measurement


def _seen(rows):
    """Positions as an array, and which rows have one."""
    z = rows[["x", "y"]].to_numpy(dtype=float)
    return z, ~np.isnan(z).any(axis=1)


def _opening(z):
    return np.array([*z, 0.0, 0.0]), np.eye(4) * 1000.0


def _kalman(f, h, q, r):
    known: dict[tuple[bytes, bool], tuple] = {}  # covariances settle, so few distinct ones occur

    def advance(cov, seen):
        key = (cov.tobytes(), seen)
        if key not in known:
            if len(known) > 10_000:
                known.clear()
            cov, gain = f @ cov @ f.T + q, None
            if seen:
                gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + r)
                rest = np.eye(4) - gain @ h
                cov = rest @ cov @ rest.T + gain @ r @ gain.T
            known[key] = (gain, cov)
        return known[key]

    def run(rows, state):
        x, cov = state or (None, None)
        out = []
        for frame, at, seen in zip(rows["frame_number"].tolist(), *_seen(rows)):
            if x is None:
                if not seen:
                    continue
                x, cov = _opening(at)
            else:
                gain, cov = advance(cov, bool(seen))
                x = f @ x
                if seen:
                    x = x + gain @ (at - x[:2])
            out.append((frame, *x, bool(seen)))
        out = pd.DataFrame(out, columns=["frame_number", "x", "y", "vx", "vy", "measured"])
        return out.round({c: 9 for c in ("x", "y", "vx", "vy")})

    return run


def _filter_steps(f, h, q, r):
    """What a run of frames does to any state, as (A, b, C, n, J): the state (m, P) before it becomes
    m' = A (I + P J)^-1 (m + P n) + b, P' = A (I + P J)^-1 P A' + C. Runs that follow each other combine,
    so the filter is a scan, however slowly it forgets."""
    one = np.eye(4)
    s_inv = np.linalg.inv(h @ q @ h.T + r)
    gain = q @ h.T @ s_inv
    seen_step = ((one - gain @ h) @ f, gain, (one - gain @ h) @ q, f.T @ h.T @ s_inv, f.T @ h.T @ s_inv @ h @ f)

    def steps(z, seen):
        n = len(z)
        k, at = seen[:, None, None], np.where(seen[:, None], z, 0.0)
        return (
            np.where(k, seen_step[0], f), at @ seen_step[1].T, np.where(k, seen_step[2], q),
            at @ seen_step[3].T, np.where(k, seen_step[4], np.zeros((n, 4, 4))),
        )

    def combine(i, j):
        (a1, b1, c1, n1, j1), (a2, b2, c2, n2, j2) = i, j
        t = lambda m: np.swapaxes(m, -1, -2)
        v = lambda m, x: (m @ x[..., None])[..., 0]
        left = a2 @ np.linalg.inv(one + c1 @ j2)
        right = t(a1) @ np.linalg.inv(one + j2 @ c1)
        return (
            left @ a1, v(left, b1 + v(c1, n2)) + b2, left @ c1 @ t(a2) + c2,
            v(right, n2 - v(j2, b1)) + n1, right @ j2 @ a1 + j1,
        )

    def total(e):
        """All steps combined, in pairs."""
        while len(e[0]) > 1:
            even = len(e[0]) // 2 * 2
            made = combine([x[0:even:2] for x in e], [x[1:even:2] for x in e])
            e = [np.concatenate([m, x[even:]]) for m, x in zip(made, e)]
        return [x[0] for x in e]

    def apply(e, state):
        (a, b, c, n, j), (m, p) = e, state
        left = a @ np.linalg.inv(one + p @ j)
        cov = left @ p @ a.T + c
        return left @ (m + p @ n) + b, (cov + cov.T) / 2.0

    return steps, combine, total, apply


_EFFECT = "array<array<double>>"


def kalman_ball(
    points: DataFrame,
    frames: DataFrame,
    dt: float = 1.0 / 30.0,
    process_noise: float = 0.1,
    measurement_noise: float = 1.0,
    layout: str = "block",
    size: int = CHUNK_FRAMES,
) -> DataFrame:
    """Constant-velocity filter over one ball centre per frame; frames without one
    are predicted. ``layout`` 'block' pairs the noise as (0,1),(2,3), as published;
    'state' pairs each position with its own velocity.

    The filter is linear, so it takes two passes over the chunks: what each does to any state, which
    one small row per chunk carries through the match, and the run from its own entry state. With the
    'block' layout it hardly forgets, so folds would go chunk by chunk. Values have 9 decimals; in long
    matches their last ones may depend on ``size``."""
    model = _constant_velocity(dt, process_noise, measurement_noise, layout)
    d = frames.select(*FRAME).join(points.select(*FRAME, "x", "y"), FRAME, "left").filter(F.col("frame_number").isNotNull())
    d = add_chunk(with_group(d, ["match_id"]), "frame_number", size)
    by = [_ID, _CHUNK]
    d = cut_lineage(d.repartition(*by), "filter-input")
    chunk = f"{_ID} string, {_CHUNK} long"

    def effects(rows):
        steps, combine, total, apply = _filter_steps(*model)
        z, seen = _seen(rows.sort_values("frame_number", kind="stable"))
        all_steps = steps(z, seen)
        first = int(np.argmax(seen)) + 1 if seen.any() else len(z)
        effect, fresh = total([x[:first] for x in all_steps]), None
        if seen.any():  # without a state, the first position seen opens one
            fresh = _opening(z[first - 1])
            if first < len(z):
                rest = total([x[first:] for x in all_steps])
                effect, fresh = combine(effect, rest), apply(rest, fresh)
        flat = lambda parts: None if parts is None else [np.ravel(x).tolist() for x in parts]
        return pd.DataFrame({_ID: [rows[_ID].iloc[0]], _CHUNK: [rows[_CHUNK].iloc[0]], "effect": [flat(effect)], "fresh": [flat(fresh)]})

    def entries(pdf):
        apply, state, made = _filter_steps(*model)[3], None, []
        for name, c, effect, fresh in pdf.sort_values(_CHUNK)[[*by, "effect", "fresh"]].itertuples(index=False):
            made.append((name, c, None if state is None else [x.ravel().tolist() for x in state]))
            if state is not None:
                state = apply([np.array(x).reshape((4, 4) if len(x) == 16 else 4) for x in effect], state)
            elif fresh is not None:
                state = (np.array(fresh[0]), np.array(fresh[1]).reshape(4, 4))
        return pd.DataFrame(made, columns=[*by, "entry"])

    def run(rows, entry):
        if not len(rows) or not len(entry):
            return pd.DataFrame(columns=["match_id", "frame_number", "x", "y", "vx", "vy", "measured"])
        state, match = entry["entry"].iloc[0], rows["match_id"].iloc[0]
        state = None if state is None else (np.array(state[0]), np.array(state[1]).reshape(4, 4))
        out = _kalman(*model)(rows.sort_values("frame_number", kind="stable"), state)
        out.insert(0, "match_id", pd.Series([None if pd.isna(match) else match] * len(out), dtype=object))
        return out

    small = d.groupBy(*by).applyInPandas(effects, f"{chunk}, effect {_EFFECT}, fresh {_EFFECT}")
    known = cut_lineage(small.groupBy(_ID).applyInPandas(entries, f"{chunk}, entry {_EFFECT}"), "filter-entries")
    shape = T.StructType([d.schema["match_id"], *T.StructType.fromDDL("frame_number long, x double, y double, vx double, vy double, measured boolean")])
    return d.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(run, shape)


def mean_velocity_3(track: DataFrame, dt: float = 1.0 / 30.0, size: int = CHUNK_FRAMES) -> DataFrame:
    """Mean of the last three steps between measured positions; with fewer than two
    steps, the filter's own velocity."""
    from courtflow.operators.ordered import with_lookback

    def steps(df, w):
        first = F.lag("x").over(w).isNull()
        df = df.withColumns(
            {
                "sx": F.when(first, F.lit(0.0)).otherwise((F.col("x") - F.lag("x").over(w)) / F.lit(dt)),
                "sy": F.when(first, F.lit(0.0)).otherwise((F.col("y") - F.lag("y").over(w)) / F.lit(dt)),
            }
        )
        near = w.rowsBetween(-2, 0)
        return df.withColumns(
            {"n": F.count(F.lit(1)).over(near), "mx": F.avg("sx").over(near), "my": F.avg("sy").over(near)}
        )

    d = with_lookback(track.filter("measured"), ["match_id"], ["frame_number"], 3, steps, size)
    return d.select(
        *FRAME,
        F.when(F.col("n") < 2, F.col("vx")).otherwise(F.col("mx")).alias("mean_vx"),
        F.when(F.col("n") < 2, F.col("vy")).otherwise(F.col("my")).alias("mean_vy"),
    )


def ball_in_motion(track: DataFrame, threshold: float = 50.0) -> DataFrame:
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return track.withColumn("in_motion", speed > threshold)


def predict_trajectory(track: DataFrame, points: int = 10, dt: float = 1.0 / 30.0) -> DataFrame:
    """The next ``points`` positions of each row: x + k dt v, one row per step."""
    step = F.explode(F.sequence(F.lit(1), F.lit(points))).alias("step")
    d = track.select(*FRAME, "x", "y", "vx", "vy", step)
    ahead = F.col("step") * F.lit(dt)
    return d.select(
        *FRAME, "step", (F.col("x") + ahead * F.col("vx")).alias("x"), (F.col("y") + ahead * F.col("vy")).alias("y")
    )


# -- recalibration debounce -----------------------------------------------------------------


def _debounce(gap: int):
    def step(rows, state):
        out = []
        for frame, px in zip(rows["frame_number"], rows["drift_px"]):
            if state is None or frame - state >= gap:
                state = int(frame)
                out.append((frame, px))
        return out, state, None

    return step


def debounced(candidates: DataFrame, gap: int, size: int = CHUNK_FRAMES) -> DataFrame:
    """Candidates that fire when each must come ``gap`` frames after the last fired."""
    d = candidates.select(*FRAME, "drift_px")
    out, _ = chunked_fold(d, ["match_id"], ["frame_number"], _debounce(gap), "frame_number long, drift_px double", size)
    return out.drop(_ID, _PIECE)


# -- within one frame ---------------------------------------------------------------------------


def nms(detections: DataFrame, thresholds: dict[str, float] | None = None, default: float = 0.4, min_score: float = 0.1) -> DataFrame:
    """Greedy suppression within frame and class, best first. A frame's boxes of a
    class are folded as an array inside the JVM; plain rows are shuffled, as a frame's
    few boxes gain nothing from lists made before, and a box alone needs no fold."""
    limit = F.lit(default)
    for c, t in (thresholds or {}).items():
        limit = F.when(F.col("class_name") == c, F.lit(t)).otherwise(limit)
    item = F.struct(-F.col("confidence"), F.col("det_no"), *[F.col(c) for c in BOX])
    d = detections.filter(F.col("confidence") > min_score).select(*FRAME, "class_name", "confidence", "det_no", *BOX)
    d = d.repartition(*FRAME).groupBy(*FRAME, "class_name").agg(F.sort_array(F.collect_list(item)).alias("boxes"))
    d = d.withColumn("limit", limit)
    box = lambda v: tuple(v[c] for c in BOX)
    keep = F.aggregate(
        "boxes",
        F.slice("boxes", 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: G.iou(box(k), box(b)) > F.col("limit")), kept).otherwise(
            F.concat(kept, F.array(b))
        ),
    )
    keep = F.when(F.size("boxes") == 1, F.col("boxes")).otherwise(keep)
    d = d.select(*FRAME, "class_name", F.explode(keep).alias("k"))
    return d.select(*FRAME, "class_name", "k.det_no", *[F.col(f"k.{c}").alias(c) for c in BOX])


def _covers(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return w * h / area if w > 0 and h > 0 and area > 0 else 0.0


def _shrink(pdf):
    out = []
    pdf = pdf.sort_values(["frame_number", "det_no"], kind="stable")
    match = pdf["match_id"].iloc[0]
    for frame, group in _by_frame(pdf, ["det_no", *BOX]):
        boxes = [list(box) for _, *box in group]
        widths = sorted(b[2] - b[0] for b in boxes)
        n = len(widths)
        median = (widths[(n - 1) // 2] + widths[n // 2]) / 2.0
        for i, b in enumerate(boxes):
            width, height = b[2] - b[0], b[3] - b[1]
            crowd = sum(_covers(b, o) > 0.1 for j, o in enumerate(boxes) if j != i)
            changed = n > 1 and (crowd >= 2 or (median > 0 and width > 1.6 * median))
            if changed:
                boxes[i] = [b[0] + width * 0.20, b[1] + height * 0.10, b[2] - width * 0.20, b[3] - height * 0.10]
            out.append((match, frame, group[i][0], *boxes[i], changed))
    return pd.DataFrame(out, columns=[*FRAME, "det_no", *BOX, "shrunk"])


def shrink_oversized_players(players: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Player boxes that are too wide or cover two others are shrunk, one after the
    other, each seeing the boxes already shrunk. Frames are independent; a task gets
    the frames of one chunk."""
    d = add_chunk(players.select(*FRAME, "det_no", *BOX), "frame_number", min(size, 1024))
    schema = "match_id long, frame_number long, det_no long, x1 double, y1 double, x2 double, y2 double, shrunk boolean"
    return d.groupBy("match_id", _CHUNK).applyInPandas(lambda pdf: _shrink(pdf), schema)
