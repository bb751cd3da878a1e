"""Jersey, bib and team-colour queries."""

from pyspark.sql import functions as F

from courtflow.functions.text import bib_token
from courtflow.operators import filters as D
from courtflow.operators import ocr as O
from courtflow.plans.registry import query, shown

CLEAN = """WITH rd AS (SELECT *, substr(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'), 1, 3) AS t FROM @ocr_reads),
cl AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) END AS num FROM rd)"""


@query(
    "ocr_clean",
    CLEAN
    + """ SELECT match_id, frame_number, det_no, t AS text, num AS jersey_number, CASE WHEN confidence >= 0.8e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium'
 WHEN confidence >= 0.2e0 THEN 'low' ELSE 'very_low' END AS confidence_level,
 CASE WHEN regexp_replace(upper(text), '[^GSWACDK]', '', 'g') IN ('GS','GA','WA','C','WD','GD','GK') THEN regexp_replace(upper(text), '[^GSWACDK]', '', 'g') END AS bib FROM cl""",
)
def _clean(t):
    d = O.clean_reads(t.ocr_reads.withColumn("bib", bib_token("text")))
    return d.select("match_id", "frame_number", "det_no", "text", "jersey_number", "confidence_level", "bib")


AREA = "confidence >= 0.2e0 AND length(text) <= 3 AND (x2-x1)*(y2-y1) BETWEEN 100 AND 10000"


@query(
    "filter_ocr_jersey",
    f"SELECT match_id, frame_number, det_no, text FROM @ocr_reads WHERE {AREA} AND (regexp_full_match(text, '[0-9]+') OR confidence >= 0.8e0)",
)
def _fj(t):
    return D.filter_ocr_jersey(t.ocr_reads).select("match_id", "frame_number", "det_no", "text")


@query(
    "filter_ocr_bib",
    f"SELECT match_id, frame_number, det_no, text FROM @ocr_reads WHERE {AREA} AND text IN ('GS','GA','WA','C','WD','GD','GK')",
)
def _fbib(t):
    return D.filter_ocr_bib(t.ocr_reads).select("match_id", "frame_number", "det_no", "text")


LIKELY = "regexp_full_match(text, '[0-9]+') AND confidence >= 0.3e0 AND TRY_CAST(text AS BIGINT) BETWEEN 1 AND 99"


@query("likely_jersey_number", f"SELECT match_id, frame_number, det_no, text FROM @ocr_reads WHERE {LIKELY}")
def _likely(t):
    return D.likely_jersey_number(t.ocr_reads).select("match_id", "frame_number", "det_no", "text")


VOTE = CLEAN + """,
pn AS (SELECT match_id, player_id, num, COUNT(*) AS n, SUM(CAST(confidence AS DECIMAL(28,9))) AS w, MAX(confidence) AS top,
 MIN(frame_number * 100 + det_no) AS seen, MIN(frame_number) AS ff, MAX(frame_number) AS lf FROM cl GROUP BY 1,2,3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, player_id ORDER BY num IS NULL, w DESC, seen) AS rw,
 ROW_NUMBER() OVER (PARTITION BY match_id, player_id ORDER BY num IS NULL, n DESC, seen) AS rc FROM pn),
v AS (SELECT match_id, player_id, MAX(CASE WHEN rw=1 THEN num END) AS jersey_number, MAX(CASE WHEN rc=1 THEN num END) AS modal,
 CAST(MAX(CASE WHEN rw=1 AND num IS NOT NULL THEN w END) AS DOUBLE) AS best, CAST(SUM(CASE WHEN num IS NOT NULL THEN w END) AS DOUBLE) AS total,
 SUM(CASE WHEN num IS NOT NULL THEN n ELSE 0 END) AS nn, MAX(top) AS top, MIN(ff) AS first_detected_frame, MAX(lf) AS last_detected_frame,
 CAST(SUM(n) AS BIGINT) AS detection_count FROM r GROUP BY 1,2),
vt AS (SELECT match_id, player_id, jersey_number, first_detected_frame, last_detected_frame, detection_count,
 CASE WHEN nn > 0 THEN 0.7e0*(best/total) + 0.3e0*least(nn/10e0, 1e0) ELSE top END AS confidence,
 CASE modal % 2 WHEN 0 THEN 'home' WHEN 1 THEN 'away' END AS team_assignment,
 detection_count/CAST(last_detected_frame-first_detected_frame+1 AS DOUBLE) AS detection_frequency FROM v),
vo AS (SELECT *, confidence >= 0.5e0 AND detection_count >= 3 AS is_confident,
 jersey_number IS NOT NULL AND confidence >= 0.6e0 AND detection_count >= 5 AS is_reliable FROM vt)"""


@query(
    "jersey_vote",
    VOTE + " SELECT * EXCLUDE (confidence, detection_frequency), ROUND(confidence,6) AS confidence, ROUND(detection_frequency,6) AS detection_frequency FROM vo",
)
def _vote(t):
    return shown(O.jersey_vote(t.ocr_reads), "confidence", "detection_frequency")


@query("confident_players", VOTE + " SELECT match_id, player_id, jersey_number FROM vo WHERE is_confident AND confidence >= 0.6e0")
def _confident(t):
    return O.confident_players(O.jersey_vote(t.ocr_reads)).select("match_id", "player_id", "jersey_number")


@query(
    "jersey_table",
    VOTE
    + " SELECT match_id, player_id, jersey_number, ROUND(confidence,6) AS confidence, team_assignment, first_detected_frame, last_detected_frame, detection_count, is_confident FROM vo",
)
def _table(t):
    return shown(O.jersey_table(O.jersey_vote(t.ocr_reads)), "confidence")


@query(
    "jersey_summary",
    VOTE + " SELECT match_id, jersey_number, COUNT(*) AS players FROM vo WHERE is_confident AND jersey_number IS NOT NULL GROUP BY 1,2",
)
def _jsummary(t):
    return O.jersey_summary(O.jersey_vote(t.ocr_reads))


@query(
    "tracking_statistics",
    VOTE
    + """ SELECT match_id, COUNT(*) AS total_players_tracked, COUNT(*) FILTER (WHERE is_confident AND confidence >= 0.6e0) AS confident_players,
 CAST(SUM(detection_count) AS BIGINT) AS total_detections, ROUND(SUM(detection_count)/CAST(COUNT(*) AS DOUBLE),6) AS average_detections_per_player FROM vo GROUP BY 1""",
)
def _tstats(t):
    return shown(O.tracking_statistics(O.jersey_vote(t.ocr_reads)), "average_detections_per_player")


@query(
    "jersey_expiry",
    "WITH m AS (SELECT match_id, MAX(frame_number) AS l FROM @ocr_reads GROUP BY 1) SELECT match_id, frame_number, det_no FROM @ocr_reads JOIN m USING (match_id) WHERE l - frame_number <= 100",
)
def _expiry(t):
    return O.jersey_expiry(t.ocr_reads).select("match_id", "frame_number", "det_no")


HIT = f"""(r.x1+r.x2)/2 BETWEEN p.x1-(p.x2-p.x1)*0.1e0 AND p.x2+(p.x2-p.x1)*0.1e0 AND (r.y1+r.y2)/2 BETWEEN p.y1-(p.y2-p.y1)*0.1e0 AND p.y2+(p.y2-p.y1)*0.1e0"""


@query(
    "ocr_in_player_region",
    f"""SELECT match_id, frame_number, det_no, text FROM @ocr_reads r WHERE {LIKELY} AND EXISTS (SELECT 1 FROM @detections p WHERE p.class_name='player'
 AND p.match_id=r.match_id AND p.frame_number=r.frame_number AND {HIT})""",
)
def _region(t):
    return O.ocr_in_player_region(t.ocr_reads, t.players).select("match_id", "frame_number", "det_no", "text")


@query(
    "ocr_player_match",
    f"""WITH j AS (SELECT r.match_id, r.frame_number, r.det_no, p.det_no AS player_no, p.track_id, r.text, r.confidence,
 ROW_NUMBER() OVER (PARTITION BY r.match_id, r.frame_number, r.det_no ORDER BY p.det_no) AS rn
 FROM (SELECT * FROM @ocr_reads WHERE {LIKELY}) r JOIN @detections p ON p.match_id=r.match_id AND p.frame_number=r.frame_number WHERE p.class_name='player' AND {HIT})
SELECT * EXCLUDE (rn) FROM j WHERE rn = 1""",
)
def _pmatch(t):
    return O.ocr_player_match(t.ocr_reads, t.players)


@query(
    "jersey_on_detections",
    CLEAN
    + """, f AS (SELECT * FROM (SELECT match_id, frame_number, num, confidence, ROW_NUMBER() OVER (PARTITION BY match_id, frame_number ORDER BY det_no) AS rn
 FROM cl WHERE coalesce(num, 0) <> 0) WHERE rn = 1)
SELECT d.match_id, d.frame_number, d.det_no, d.track_id, f.num AS jersey_number, f.confidence AS jersey_confidence FROM @detections d
 LEFT JOIN f USING (match_id, frame_number) WHERE d.class_name = 'player'""",
)
def _on(t):
    df = O.jersey_on_detections(t.players, t.ocr_reads)
    return df.select("match_id", "frame_number", "det_no", "track_id", "jersey_number", "jersey_confidence")


@query(
    "bib_positions",
    """WITH b AS (SELECT *, regexp_replace(upper(text), '[^GSWACDK]', '', 'g') AS position FROM @ocr_reads)
SELECT match_id, frame_number, ROUND(timestamp,6) AS timestamp, position, confidence, x1, y1, x2, y2, player_id FROM b
 WHERE position IN ('GS','GA','WA','C','WD','GD','GK')""",
)
def _bib(t):
    return shown(O.bib_positions(t.ocr_reads), "timestamp")


@query(
    "nearest_team_color",
    """WITH d AS (SELECT match_id, frame_number, det_no, MIN(sqrt((r-200e0)*(r-200e0)+(g-40e0)*(g-40e0)+(b-60e0)*(b-60e0))) AS hd,
 MIN(sqrt((r-30e0)*(r-30e0)+(g-90e0)*(g-90e0)+(b-220e0)*(b-220e0))) AS ad FROM @jersey_colors GROUP BY 1,2,3)
SELECT match_id, frame_number, det_no, ROUND(hd,6) AS home_distance, ROUND(ad,6) AS away_distance, CASE WHEN hd < ad THEN 'home' ELSE 'away' END AS team FROM d""",
)
def _color(t):
    return shown(O.nearest_team_color(t.jersey_colors, (200, 40, 60), (30, 90, 220)), "home_distance", "away_distance")


@query(
    "team_color_stats",
    """SELECT match_id, team, COUNT(*) AS color_count, CAST(floor(SUM(r)/CAST(COUNT(*) AS DOUBLE)) AS BIGINT) AS avg_r,
 CAST(floor(SUM(g)/CAST(COUNT(*) AS DOUBLE)) AS BIGINT) AS avg_g, CAST(floor(SUM(b)/CAST(COUNT(*) AS DOUBLE)) AS BIGINT) AS avg_b FROM @jersey_colors GROUP BY 1,2""",
)
def _color_stats(t):
    return O.team_color_stats(t.jersey_colors)


def _off(a: str, b: str) -> str:
    return "(" + "+".join(f"({a}.{x}-{b}{x})*({a}.{x}-{b}{x})" for x in "rgb") + ")"


def _rounds(n: int) -> str:
    """The rounds of the clustering, each from the centres of the one before."""
    out = []
    for i in range(n):
        mean = ", ".join(f"CASE WHEN o.done OR coalesce(m.n{k},0) = 0 THEN o.{c}{x} ELSE m.{x}{k}/m.n{k} END AS {c}{x}" for k, c in ((0, "p"), (1, "q")) for x in "rgb")
        near = f"{_off('t', 'o.p')} <= {_off('t', 'o.q')}"
        sums = ", ".join(f"SUM(t.{x}*t.n) FILTER (WHERE {'NOT ' * k}({near})) AS {x}{k}" for k in (0, 1) for x in "rgb")
        counts = ", ".join(f"SUM(t.n) FILTER (WHERE {'NOT ' * k}({near})) AS n{k}" for k in (0, 1))
        out.append(f"""m{i} AS (SELECT t.match_id, {sums}, {counts} FROM tones t JOIN k{i} o USING (match_id) GROUP BY 1),
w{i} AS (SELECT o.match_id, o.done, {", ".join(f"o.{c}{x} AS {c}{x}0" for c in "pq" for x in "rgb")}, {mean} FROM k{i} o JOIN m{i} m USING (match_id)),
k{i + 1} AS MATERIALIZED (SELECT match_id, {", ".join(f"{c}{x}" for c in "pq" for x in "rgb")}, done OR greatest({", ".join("+".join(f"({c}{x}-{c}{x}0)*({c}{x}-{c}{x}0)" for x in "rgb") for c in "pq")}) <= 1 AS done FROM w{i})""")
    return ",\n".join(out)


CLUSTERS = f"""WITH tones AS MATERIALIZED (SELECT match_id, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(COUNT(*) AS DOUBLE) AS n FROM @jersey_colors GROUP BY ALL),
dark AS (SELECT match_id, r AS pr, g AS pg, b AS pb FROM tones QUALIFY ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY r+g+b, r, g, b) = 1),
k0 AS MATERIALIZED (SELECT d.*, t.r AS qr, t.g AS qg, t.b AS qb, false AS done FROM tones t JOIN dark d USING (match_id)
 QUALIFY ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY {_off('t', 'd.p')} DESC, t.r DESC, t.g DESC, t.b DESC) = 1),
{_rounds(20)},
latest AS (SELECT * FROM @jersey_colors QUALIFY ROW_NUMBER() OVER (PARTITION BY match_id, player_id ORDER BY frame_number DESC, det_no DESC, color_no DESC) = 1)
SELECT t.match_id, t.player_id, CASE WHEN ({_off('t', 'o.p')} <= {_off('t', 'o.q')}) = (pr+pg+pb <= qr+qg+qb) THEN 'home' ELSE 'away' END AS team FROM latest t JOIN k20 o USING (match_id)"""


@query("cluster_teams", CLUSTERS)
def _cluster(t):
    return O.cluster_teams(t.jersey_colors)
