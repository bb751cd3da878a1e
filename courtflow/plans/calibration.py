"""Calibration queries."""

from pyspark.sql import functions as F

from courtflow.functions import geometry as G
from courtflow.functions.court import in_court_polygon
from courtflow.operators import calibration as C
from courtflow.plans.registry import query, shown

H = ", ".join(f"c.h{i}" for i in range(9))
ASOF = f"""WITH x AS (SELECT d.match_id, d.frame_number, d.det_no, d.class_name, (d.x1+d.x2)/2 AS cx, (d.y1+d.y2)/2 AS cy, d.x1, d.y1, d.x2, d.y2, {H}
 FROM @detections d ASOF LEFT JOIN @calibration_rows c ON d.match_id = c.match_id AND d.frame_number >= c.from_frame)"""
W = "(h6*{x}+h7*{y}+h8)"


def proj(x: str, y: str, a: str) -> str:
    i = 0 if a == "x" else 3
    num = f"(h{i}*{x}+h{i + 1}*{y}+h{i + 2})"
    w = W.format(x=x, y=y)
    return f"CASE WHEN {w} <> 0 THEN {num}/{w} ELSE {num} END"


def boxes(t):
    """Detections without the columns that no calibration query reads: whole rows are shuffled and sorted."""
    return t.detections.select("match_id", "frame_number", "det_no", *G.BOX)


@query(
    "with_court_coords",
    ASOF + f" SELECT match_id, frame_number, det_no, ROUND({proj('cx', 'cy', 'x')},6) AS court_x, ROUND({proj('cx', 'cy', 'y')},6) AS court_y FROM x",
)
def _coords(t):
    d = C.with_court_coords(boxes(t), t.calibrations, tasks=C.tasks_for(t.detections))
    return shown(d.select("match_id", "frame_number", "det_no", "court_x", "court_y"), "court_x", "court_y")


CORNERS = {a: [proj(x, y, a) for x in ("x1", "x2") for y in ("y1", "y2")] for a in "xy"}


@query(
    "bbox_to_court",
    ASOF
    + " SELECT match_id, frame_number, det_no, "
    + ", ".join(f"ROUND({f}({', '.join(CORNERS[a])}),6) AS {n}" for n, f, a in (("bx1", "least", "x"), ("by1", "least", "y"), ("bx2", "greatest", "x"), ("by2", "greatest", "y")))
    + " FROM x",
)
def _boxes(t):
    d = C.calibration_as_of(boxes(t), t.calibrations, tasks=C.tasks_for(t.detections))
    x1, y1, x2, y2 = G.map_box("h", G.box())
    d = d.select("match_id", "frame_number", "det_no", x1.alias("bx1"), y1.alias("by1"), x2.alias("bx2"), y2.alias("by2"))
    return shown(d, "bx1", "by1", "bx2", "by2")


DET = "(h0*(h4*h8-h5*h7)-h1*(h3*h8-h5*h6)+h2*(h3*h7-h4*h6))"


@query(
    "court_to_pixel_roundtrip",
    ASOF + f" SELECT match_id, frame_number, det_no, CASE WHEN {DET} <> 0 THEN ROUND(cx,3) + 0e0 END AS px, CASE WHEN {DET} <> 0 THEN ROUND(cy,3) + 0e0 END AS py FROM x",
)
def _roundtrip(t):
    d = C.with_court_coords(boxes(t), t.calibrations, tasks=C.tasks_for(t.detections)).withColumn("h_inv", G.inverse("h"))
    b = G.box()
    px, py = G.court_to_pixel("h_inv", "court_x", "court_y", G.court_weight("h", G.center_x(b), G.center_y(b)))
    d = d.select("match_id", "frame_number", "det_no", px.alias("px"), py.alias("py"))
    return d.withColumns({c: F.round(F.col(c), 3) + F.lit(0.0) for c in ("px", "py")})


@query(
    "matrix_ok",
    f"SELECT match_id, from_frame, abs({DET}) >= 1e-6 AND confidence > 0 AS is_valid FROM @calibration_rows",
)
def _matrix_ok(t):
    return C.valid_calibrations(t.calibrations).select("match_id", "from_frame", "is_valid")


@query(
    "blended_history",
    "WITH b AS (SELECT *, "
    + ", ".join(f"LAG(h{i}) OVER (PARTITION BY match_id ORDER BY from_frame) AS o{i}" for i in range(9))
    + " FROM @calibration_rows) SELECT match_id, from_frame, "
    + ", ".join(f"ROUND(CASE WHEN o0 IS NULL THEN h{i} ELSE 0.7e0*o{i}+0.3e0*h{i} END,9) AS h{i}" for i in range(9))
    + " FROM b",
)
def _blend(t):
    d = C.blended_history(t.calibrations, 0.3)
    return d.select("match_id", "from_frame", *[F.round(F.element_at("h", i + 1), 9).alias(f"h{i}") for i in range(9)])


@query(
    "select_best_calibration",
    "SELECT match_id, from_frame, confidence, method FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY confidence DESC, from_frame) AS rn FROM @calibration_rows) WHERE rn = 1",
)
def _best(t):
    return C.select_best_calibration(t.calibrations).select("match_id", "from_frame", "confidence", "method")


ERR = f"""WITH best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY confidence DESC, from_frame) AS rn FROM @calibration_rows) WHERE rn = 1),
e AS (SELECT p.match_id, p.point_no, c.from_frame, sqrt(({proj('px', 'py', 'x')}-court_x)*({proj('px', 'py', 'x')}-court_x)
 +({proj('px', 'py', 'y')}-court_y)*({proj('px', 'py', 'y')}-court_y)) AS error FROM @calibration_points p JOIN best c USING (match_id))"""


@query("reprojection_errors", ERR + " SELECT match_id, point_no, from_frame, ROUND(error,6) AS error FROM e")
def _errors(t):
    d = C.reprojection_errors(t.calibration_points, C.select_best_calibration(t.calibrations))
    return shown(d.select("match_id", "point_no", "from_frame", "error"), "error")


@query(
    "transformation_error_stats",
    ERR
    + """ SELECT match_id, from_frame, ROUND(AVG(error),8) AS mean_error, ROUND(MAX(error),8) AS max_error, ROUND(STDDEV_POP(error),8) AS std_error,
 AVG(error) < 0.5e0 AND MAX(error) < 1 AS is_valid FROM e GROUP BY 1,2""",
)
def _error_stats(t):
    d = C.transformation_error_stats(C.reprojection_errors(t.calibration_points, C.select_best_calibration(t.calibrations)))
    return shown(d, "mean_error", "max_error", "std_error", places=8)


@query(
    "hoop_quality_by_frame",
    """SELECT match_id, frame_number, ROUND(AVG(confidence*greatest(0e0, least(1e0, 1e0-abs((x2-x1)*(y2-y1)-10000e0)/10000e0))),8) AS quality, COUNT(*) AS hoops
 FROM @detections WHERE class_name='hoop' GROUP BY 1,2""",
)
def _hoop_quality(t):
    return shown(C.hoop_quality_by_frame(t.hoops), "quality", places=8)


@query(
    "hoop_detection_stats",
    """WITH f AS (SELECT match_id, frame_number, COUNT(*) AS c, SUM(confidence) AS s, MIN(confidence) AS lo, MAX(confidence) AS hi FROM @detections WHERE class_name='hoop' GROUP BY 1,2)
SELECT match_id, ROUND(SUM(s)/SUM(c),8) AS avg_confidence, MIN(lo) AS min_confidence, MAX(hi) AS max_confidence, ROUND(AVG(c),8) AS avg_hoops_per_frame,
 COUNT(*) FILTER (WHERE c >= 2) AS frames_with_2_hoops, COUNT(*) FILTER (WHERE c = 1) AS frames_with_1_hoop FROM f GROUP BY 1""",
)
def _hoop_stats(t):
    return shown(C.hoop_detection_stats(t.hoops), "avg_confidence", "avg_hoops_per_frame", places=8)


@query(
    "calibration_quality",
    """SELECT match_id, ROUND(AVG(accuracy),8) AS avg_accuracy, MIN(accuracy) AS min_accuracy, MAX(accuracy) AS max_accuracy, ROUND(STDDEV_POP(accuracy),8) AS std_accuracy,
 COUNT(*) FILTER (WHERE accuracy > 0.8e0) AS high_quality, COUNT(*) FILTER (WHERE accuracy BETWEEN 0.6e0 AND 0.8e0) AS medium_quality,
 COUNT(*) FILTER (WHERE accuracy < 0.6e0) AS low_quality FROM @calibration_attempts WHERE success GROUP BY 1""",
)
def _quality(t):
    return shown(C.calibration_quality(t.calibration_attempts), "avg_accuracy", "std_accuracy", places=8)


@query(
    "calibration_methods",
    "SELECT match_id, method, COUNT(*) AS n FROM @calibration_attempts WHERE success GROUP BY 1,2",
)
def _methods(t):
    return C.method_distribution(t.calibration_attempts)


@query(
    "calibration_attempt_summary",
    """SELECT match_id, COUNT(*) AS total_attempts, COUNT(*) FILTER (WHERE success) AS successful_attempts, COUNT(*) FILTER (WHERE NOT success) AS failed_attempts,
 ROUND(COUNT(*) FILTER (WHERE success)/CAST(COUNT(*) AS DOUBLE),8) AS success_rate, MAX(confidence) AS best_confidence,
 ROUND(coalesce(AVG(accuracy) FILTER (WHERE success),0e0),8) AS average_accuracy FROM @calibration_attempts GROUP BY 1""",
)
def _attempts(t):
    return shown(C.calibration_attempt_summary(t.calibration_attempts), "success_rate", "average_accuracy", places=8)


@query(
    "best_calibration_parameters",
    """WITH p AS (SELECT parameter, COUNT(*) FILTER (WHERE success)/CAST(COUNT(*) AS DOUBLE)*AVG(accuracy) FILTER (WHERE success) AS score FROM @calibration_attempts GROUP BY 1)
SELECT ROUND(parameter,8) AS parameter, ROUND(score,8) AS score FROM p WHERE score > 0 ORDER BY p.score DESC, p.parameter LIMIT 1""",
)
def _params(t):
    return shown(C.best_calibration_parameters(t.calibration_attempts), "parameter", "score", places=8)


@query(
    "calibration_recommendations",
    """WITH f AS (SELECT match_id, COUNT(*) AS frames FROM @frames GROUP BY 1),
a AS (SELECT match_id, COUNT(*) AS wh, COUNT(*) FILTER (WHERE success) AS ok, AVG(accuracy) FILTER (WHERE success) AS acc FROM @calibration_attempts GROUP BY 1)
SELECT match_id, concat_ws(' | ', CASE WHEN coalesce(wh,0) < frames*0.3e0 THEN 'Low hoop detection rate - consider lowering confidence threshold' END,
 CASE WHEN coalesce(ok,0) < coalesce(wh,0)*0.5e0 THEN 'Low calibration success rate - check hoop positioning accuracy' END,
 CASE WHEN acc < 0.7e0 THEN 'Low calibration accuracy - improve hoop detection quality' END) AS recommendations FROM f LEFT JOIN a USING (match_id)""",
)
def _recommend(t):
    d = C.calibration_recommendations(t.calibration_attempts, t.frames)
    return d.select("match_id", F.array_join("recommendations", " | ").alias("recommendations"))


@query(
    "estimate_hoop_targets",
    """WITH n AS (SELECT f.match_id, f.frame_number, COUNT(d.det_no) AS hoops FROM @frames f LEFT JOIN @detections d
 ON d.match_id=f.match_id AND d.frame_number=f.frame_number AND d.class_name='hoop' GROUP BY 1,2)
SELECT *, CASE WHEN hoops >= 2 THEN 0.9e0 WHEN hoops = 1 THEN 0.5e0 ELSE 0e0 END AS confidence, CASE WHEN hoops >= 2 THEN 0e0 END AS left_x,
 CASE WHEN hoops >= 2 THEN 30.5e0 END AS right_x, CASE WHEN hoops >= 2 THEN 7.625e0 END AS goal_y FROM n""",
)
def _targets(t):
    return C.estimate_hoop_targets(t.hoops, t.frames)


DECISIONS = """c AS (SELECT *, LAG(frame_number) OVER (PARTITION BY match_id ORDER BY frame_number) AS p FROM @hoop_drift
 WHERE frame_number % 30 = 0 AND hoops >= 1 AND drift_px > 20),
r AS (SELECT *, SUM(CASE WHEN p IS NULL OR frame_number - p >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS run FROM c),
i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, run ORDER BY frame_number) AS k FROM r),
decided AS (SELECT match_id, frame_number, drift_px FROM i WHERE k % 2 = 1)"""


@query("auto_recalibrate", f"WITH {DECISIONS} SELECT * FROM decided")
def _recalibrate(t):
    return C.auto_recalibrate(t.hoop_drift)


HS = [f"h{i}" for i in range(9)]
RECALIBRATED = f"""WITH RECURSIVE {DECISIONS},
st AS (SELECT match_id, from_frame, 0 AS kind, {", ".join(HS)} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY from_frame) AS k FROM @calibration_rows) WHERE k = 1
 UNION ALL SELECT d.match_id, d.frame_number, 1, {H} FROM decided d ASOF JOIN @calibration_rows c ON d.match_id = c.match_id AND d.frame_number >= c.from_frame),
nu AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY from_frame, kind) AS n FROM st),
bl AS (SELECT match_id, from_frame, n, {", ".join(HS)} FROM nu WHERE n = 1
 UNION ALL SELECT nu.match_id, nu.from_frame, nu.n, {", ".join(f"0.3e0 * nu.{h} + 0.7e0 * bl.{h}" for h in HS)} FROM bl JOIN nu ON nu.match_id = bl.match_id AND nu.n = bl.n + 1),
cr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, from_frame ORDER BY n DESC) AS k FROM bl) WHERE k = 1)"""


def matrices(t):
    return C.recalibrated(t.calibrations, C.auto_recalibrate(t.hoop_drift))


@query("recalibrated", RECALIBRATED + f" SELECT match_id, from_frame, {', '.join(f'ROUND({h}, 9) AS {h}' for h in HS)} FROM cr")
def _recalibrated(t):
    return matrices(t).select("match_id", "from_frame", *[F.round(F.element_at("h", i + 1), 9).alias(h) for i, h in enumerate(HS)])


@query(
    "recalibrated_court_coords",
    RECALIBRATED
    + f""", x AS (SELECT d.match_id, d.frame_number, d.det_no, (d.x1+d.x2)/2 AS cx, (d.y1+d.y2)/2 AS cy, {H}
 FROM @detections d ASOF LEFT JOIN cr c ON d.match_id = c.match_id AND d.frame_number >= c.from_frame)
SELECT match_id, frame_number, det_no, ROUND({proj('cx', 'cy', 'x')},6) AS court_x, ROUND({proj('cx', 'cy', 'y')},6) AS court_y FROM x""",
)
def _recalibrated_coords(t):
    d = C.with_court_coords(boxes(t), matrices(t), tasks=C.tasks_for(t.detections))
    return shown(d.select("match_id", "frame_number", "det_no", "court_x", "court_y"), "court_x", "court_y")


INV = ["(h4*h8-h5*h7)", "(h2*h7-h1*h8)", "(h1*h5-h2*h4)", "(h5*h6-h3*h8)", "(h0*h8-h2*h6)", "(h2*h3-h0*h5)",
       "(h3*h7-h4*h6)", "(h1*h6-h0*h7)", "(h0*h4-h1*h3)"]


def _corner(cx: str, cy: str, n: int) -> str:
    w = f"(i6*{cx}+i7*{cy}+i8)"
    xy = [f"(i{3 * k}*{cx}+i{3 * k + 1}*{cy}+i{3 * k + 2})" for k in (0, 1)]
    return ", ".join(f"trunc(CASE WHEN {w} <> 0 THEN {v}/{w} ELSE {v} END) AS {a}{n}" for a, v in zip("pq", xy))


def _side(i: int, j: int) -> str:
    return f"((p{j}-p{i})*(cy-q{i})-(q{j}-q{i})*(cx-p{i}))"


SIDES = [_side(0, 1), _side(1, 2), _side(2, 3), _side(3, 0)]


@query(
    "in_court_polygon",
    ASOF
    + f", v AS (SELECT *, {', '.join(f'{e}/{DET} AS i{n}' for n, e in enumerate(INV))} FROM x WHERE {DET} <> 0), "
    + f"o AS (SELECT *, {_corner('0e0', '0e0', 0)}, {_corner('30.5e0', '0e0', 1)}, {_corner('30.5e0', '15.25e0', 2)}, {_corner('0e0', '15.25e0', 3)} FROM v) "
    + "SELECT match_id, frame_number, det_no, ("
    + " AND ".join(f"{s} <= 0" for s in SIDES)
    + ") OR ("
    + " AND ".join(f"{s} >= 0" for s in SIDES)
    + ") AS inside FROM o",
)
def _polygon(t):
    d = C.calibration_as_of(boxes(t), C.with_inverse(t.calibrations), carry="outline", tasks=C.tasks_for(t.detections))
    b = G.box()
    inside = in_court_polygon("outline", G.center_x(b), G.center_y(b))
    return d.filter(F.col("outline").isNotNull()).select("match_id", "frame_number", "det_no", inside.alias("inside"))
