"""Long form: one row per game and model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from calibrant.operators.models import ALL_MODELS

GAME = ["game_id", "season", "date", "team1", "team2", "score1", "score2"]


def to_long(wide: DataFrame, models: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Pick columns to rows (model, won, prob, team); `keep` names further columns to carry."""
    models = models or [m for m in ALL_MODELS if m in wide.columns]
    ids = [*GAME, *(keep or [])]
    return wide.unpivot(ids, models, "model", "pick").select(*ids, "model", "pick.won", "pick.prob", "pick.team")
