"""Model weights: fixed presets, defaults, and which models a configuration needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.operators.knn import MODELS

#: The presets for comparing configurations.
PRESETS: dict[str, dict[str, float]] = {
    "CLIP + color (old baseline)": {"clip": 1.0, "color": 0.5},
    "PE-Core L only": {"pecore_l": 1.0},
    "PE-Core G only": {"pecore_g": 1.0},
    "PE-Core L + color": {"pecore_l": 1.0, "color": 0.5},
    "PE-Core G + color": {"pecore_g": 1.0, "color": 0.5},
    "PE-Core G + CLIP": {"pecore_g": 1.0, "clip": 1.0},
    "PE-Core G + CLIP + color": {"pecore_g": 1.0, "clip": 1.0, "color": 0.5},
    "PE-Core L + CLIP + color": {"pecore_l": 1.0, "clip": 1.0, "color": 0.5},
    "DINOv2 only": {"dino": 1.0},
    "DINOv2 + CLIP + color": {"dino": 1.0, "clip": 1.0, "color": 0.5},
    "PE-Core G + DINOv2": {"pecore_g": 1.0, "dino": 1.0},
    "DINOv3 only": {"dinov3": 1.0},
    "DINOv3 + color": {"dinov3": 1.0, "color": 0.5},
    "DINOv3 + PE-Core G + color": {"dinov3": 1.0, "pecore_g": 1.0, "color": 0.5},
    "All models equal": {"clip": 1.0, "dino": 1.0, "dinov3": 1.0, "pecore_l": 1.0, "pecore_g": 1.0, "color": 0.5},
}


def required_models(weights: dict[str, float] | None) -> list[str]:
    """All models where no weights are given."""
    return list(MODELS) if weights is None else [m for m in MODELS if (weights.get(m) or 0) > 0]


def presets(spark: SparkSession) -> DataFrame:
    """(preset, model, weight)."""
    return spark.createDataFrame([(p, m, w) for p, ws in PRESETS.items() for m, w in ws.items()], "preset string, model string, weight double")
