"""League tables from match results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import safe_div

TIE_KEYS = ["points", "goal_average", "goal_difference", "goals_for"]


def _sides(games: DataFrame) -> DataFrame:
    """One row per team and game, both sides from a single scan."""

    def side(no, team, goals_for, goals_against):
        return F.struct(
            F.col(team).alias("team"),
            F.col(goals_for).alias("gf"),
            F.col(goals_against).alias("ga"),
            (F.col("game_id") * 2 + no).alias("seen"),
        )

    both = F.array(side(0, "home_team", "home_score", "away_score"), side(1, "away_team", "away_score", "home_score"))
    return games.select("category", F.explode(both).alias("s")).select("category", "s.*")


def standings(games: DataFrame) -> DataFrame:
    """Per category and team: results, goals, goal average and points (2 / 1 / 0).

    Goal average is infinite without goals against, 0 without any goals.
    """
    gf, ga = F.col("gf"), F.col("ga")
    total = _sides(games).groupBy("category", "team").agg(
        F.count(F.lit(1)).alias("played"),
        F.count_if(gf > ga).alias("won"),
        F.count_if(gf == ga).alias("drawn"),
        F.count_if(gf < ga).alias("lost"),
        F.sum(gf).alias("goals_for"),
        F.sum(ga).alias("goals_against"),
        F.min("seen").alias("first_seen"),
    )
    return total.withColumns(
        {
            "goal_difference": F.col("goals_for") - F.col("goals_against"),
            "goal_average": F.when(F.col("goals_against") > 0, safe_div("goals_for", "goals_against"))
            .when(F.col("goals_for") > 0, F.lit(float("inf")))
            .otherwise(F.lit(0.0)),
            "points": F.col("won") * 2 + F.col("drawn"),
        }
    )


def league_table(table: DataFrame) -> DataFrame:
    """Positions 1..n per category; full ties keep the order of first appearance."""
    w = Window.partitionBy("category").orderBy(*[F.desc(k) for k in TIE_KEYS], "first_seen")
    return table.withColumn("position", F.row_number().over(w).cast("long"))


def tie_breaker(table: DataFrame) -> DataFrame:
    """Rank by the tie-break keys alone: equal rank means the teams are tied."""
    w = Window.partitionBy("category").orderBy(*[F.desc(k) for k in TIE_KEYS])
    return table.withColumn("tie_rank", F.rank().over(w).cast("long"))


def team_statistics(table: DataFrame) -> DataFrame:
    """Rates per game at full precision (round only for display)."""
    return table.withColumns(
        {
            "win_rate": safe_div("won", "played"),
            "goals_per_game": safe_div("goals_for", "played"),
            "goals_against_per_game": safe_div("goals_against", "played"),
            "points_per_game": safe_div("points", "played"),
        }
    )


def team_standing(table: DataFrame, team: str, category: str) -> DataFrame:
    return table.filter((F.col("team") == team) & (F.col("category") == category))


def league_statistics(table: DataFrame) -> DataFrame:
    """Teams, games (each counted by both sides) and goals per category."""
    return table.groupBy("category").agg(
        F.count(F.lit(1)).alias("teams"),
        F.floor(F.sum("played") / F.lit(2.0)).cast("long").alias("games"),
        F.sum("goals_for").alias("goals"),
    )


def pair_games(games: DataFrame) -> DataFrame:
    """Every game seen from the alphabetically first team of its pair."""
    home_first = F.col("home_team") <= F.col("away_team")
    return games.select(
        "category",
        F.least("home_team", "away_team").alias("team1"),
        F.greatest("home_team", "away_team").alias("team2"),
        "game_id",
        "game_date",
        F.when(home_first, F.col("home_score")).otherwise(F.col("away_score")).alias("team1_score"),
        F.when(home_first, F.col("away_score")).otherwise(F.col("home_score")).alias("team2_score"),
    )


def head_to_head_summary(games: DataFrame) -> DataFrame:
    """Record of every pair that met. The games themselves stay rows
    (``pair_games``): a pair's list has no bound."""
    a, b = F.col("team1_score"), F.col("team2_score")
    return pair_games(games).groupBy("category", "team1", "team2").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(a > b).alias("team1_wins"),
        F.count_if(b > a).alias("team2_wins"),
        F.count_if(a == b).alias("draws"),
        F.sum(a).alias("team1_goals"),
        F.sum(b).alias("team2_goals"),
    )


def head_to_head(games: DataFrame, team1: str, team2: str, category: str) -> DataFrame:
    """Games between two teams in a category, whoever played at home."""
    h, w = F.col("home_team"), F.col("away_team")
    return games.filter(
        (F.col("category") == category)
        & (((h == team1) & (w == team2)) | ((h == team2) & (w == team1)))
    )
