"""League queries."""

from pyspark.sql import functions as F

from courtflow.operators import standings as S
from courtflow.plans.registry import query, shown

STANDINGS_CTE = """
WITH sides AS (
  SELECT category, home_team AS team, home_score AS gf, away_score AS ga, game_id * 2 AS seen FROM @game_results
  UNION ALL
  SELECT category, away_team, away_score, home_score, game_id * 2 + 1 FROM @game_results),
st AS (SELECT category, team, COUNT(*) AS played,
  CAST(SUM(CASE WHEN gf > ga THEN 1 ELSE 0 END) AS BIGINT) AS won,
  CAST(SUM(CASE WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS drawn,
  CAST(SUM(CASE WHEN gf < ga THEN 1 ELSE 0 END) AS BIGINT) AS lost,
  CAST(SUM(gf) AS BIGINT) AS goals_for, CAST(SUM(ga) AS BIGINT) AS goals_against, MIN(seen) AS first_seen
  FROM sides GROUP BY category, team),
tab AS (SELECT *, goals_for - goals_against AS goal_difference,
  CASE WHEN goals_against > 0 THEN goals_for / CAST(goals_against AS DOUBLE)
       WHEN goals_for > 0 THEN CAST('inf' AS DOUBLE) ELSE 0e0 END AS goal_average,
  won * 2 + drawn AS points FROM st)
"""
COLS = ["category", "team", "played", "won", "drawn", "lost", "goals_for", "goals_against",
        "goal_difference", "goal_average", "points"]
SQL_COLS = ", ".join(c if c != "goal_average" else "ROUND(goal_average, 6) AS goal_average" for c in COLS)


@query("standings", STANDINGS_CTE + f"SELECT {SQL_COLS} FROM tab")
def _standings(t):
    return shown(S.standings(t.game_results).select(*COLS), "goal_average")


@query(
    "league_table",
    STANDINGS_CTE
    + f"""SELECT {SQL_COLS}, ROW_NUMBER() OVER (PARTITION BY category ORDER BY points DESC, tab.goal_average DESC,
  goal_difference DESC, goals_for DESC, first_seen) AS position FROM tab""",
)
def _league_table(t):
    return shown(S.league_table(S.standings(t.game_results)).select(*COLS, "position"), "goal_average")


@query(
    "tie_breaker",
    STANDINGS_CTE
    + """SELECT category, team, RANK() OVER (PARTITION BY category ORDER BY points DESC, goal_average DESC,
  goal_difference DESC, goals_for DESC) AS tie_rank FROM tab""",
)
def _tie_breaker(t):
    return S.tie_breaker(S.standings(t.game_results)).select("category", "team", "tie_rank")


@query(
    "team_statistics",
    STANDINGS_CTE
    + """SELECT category, team, ROUND(won / CAST(played AS DOUBLE), 6) AS win_rate,
  ROUND(goals_for / CAST(played AS DOUBLE), 6) AS goals_per_game,
  ROUND(goals_against / CAST(played AS DOUBLE), 6) AS goals_against_per_game,
  ROUND(points / CAST(played AS DOUBLE), 6) AS points_per_game FROM tab""",
)
def _team_statistics(t):
    rates = ["win_rate", "goals_per_game", "goals_against_per_game", "points_per_game"]
    return shown(S.team_statistics(S.standings(t.game_results)).select("category", "team", *rates), *rates)


@query("team_standing", STANDINGS_CTE + f"SELECT {SQL_COLS} FROM tab WHERE team = 'T3' AND category = 'U15'")
def _team_standing(t):
    return shown(S.team_standing(S.standings(t.game_results), "T3", "U15").select(*COLS), "goal_average")


@query(
    "league_statistics",
    STANDINGS_CTE
    + """SELECT category, COUNT(*) AS teams, CAST(floor(SUM(played) / 2e0) AS BIGINT) AS games,
  CAST(SUM(goals_for) AS BIGINT) AS goals FROM tab GROUP BY category""",
)
def _league_statistics(t):
    return S.league_statistics(S.standings(t.game_results))


PAIRS_CTE = """
WITH p AS (SELECT category, least(home_team, away_team) AS team1, greatest(home_team, away_team) AS team2,
  CASE WHEN home_team <= away_team THEN home_score ELSE away_score END AS s1,
  CASE WHEN home_team <= away_team THEN away_score ELSE home_score END AS s2 FROM @game_results)
"""


@query(
    "head_to_head_summary",
    PAIRS_CTE
    + """SELECT category, team1, team2, COUNT(*) AS games, COUNT(*) FILTER (WHERE s1 > s2) AS team1_wins,
  COUNT(*) FILTER (WHERE s2 > s1) AS team2_wins, COUNT(*) FILTER (WHERE s1 = s2) AS draws,
  CAST(SUM(s1) AS BIGINT) AS team1_goals, CAST(SUM(s2) AS BIGINT) AS team2_goals
FROM p GROUP BY category, team1, team2""",
)
def _h2h_summary(t):
    return S.head_to_head_summary(t.game_results)


@query(
    "head_to_head",
    """SELECT game_id, CAST(game_date AS VARCHAR) AS game_date, home_team, away_team, home_score, away_score
FROM @game_results WHERE category = 'U18' AND
 ((home_team = 'T1' AND away_team = 'T5') OR (home_team = 'T5' AND away_team = 'T1'))""",
)
def _h2h(t):
    return S.head_to_head(t.game_results, "T1", "T5", "U18").select(
        "game_id", F.col("game_date").cast("string").alias("game_date"), "home_team", "away_team", "home_score", "away_score"
    )
