"""Named settings for digestion and prediction."""

from __future__ import annotations

from typing import Any

# Defaults and presets.
DIGEST_DEFAULTS = {"enzyme": "trypsin-p", "missed_cleavages": 1, "min_length": 7, "max_length": 30, "charges": "2,3,4", "min_precursor_mz": None, "max_precursor_mz": None, "charge_length_rules": ""}
PREDICT_DEFAULTS = {"fragment_types": "b,y", "fragment_charges": "1", "min_fragment_series": None, "max_fragment_series": None, "min_product_mz": None, "max_product_mz": None, "recommended_top_n": None}
_WIDE = {"charges": "1,2,3,4", "min_precursor_mz": 300.0, "max_precursor_mz": 1800.0}
_WINDOWED = {"charges": "2,3,4", "min_precursor_mz": 400.0, "max_precursor_mz": 1200.0}
_THREE = {"fragment_charges": "1,2,3", "min_fragment_series": 3, "recommended_top_n": 7}
_TWO = {"fragment_charges": "1,2", "min_fragment_series": 3}
PRESETS: dict[str, tuple[dict[str, Any], dict[str, Any]]] = {
    "none": ({}, {}),
    "generic-dia": (_WIDE, _THREE),
    "generic-dia-windowed": (_WINDOWED, _THREE),
    "generic-dia-strict": (_WINDOWED | {"charge_length_rules": "4:12"}, _THREE),
    "diann-like": (_WINDOWED, _TWO | {"recommended_top_n": 7}),
    "skyline-dia-like": (_WIDE, _TWO | {"recommended_top_n": 6}),
    "skyline-export-like": (_WIDE, _TWO | {"recommended_top_n": 6}),
}


def names() -> list[str]:
    return sorted(PRESETS)


def _resolve(which: int, preset: str, defaults: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    preset = preset.strip().lower()
    if preset not in PRESETS:
        raise ValueError(f"preset {preset!r} is not one of {', '.join(names())}")
    return defaults | PRESETS[preset][which] | {k: v for k, v in given.items() if v is not None}


def digest_settings(preset: str = "none", **given: Any) -> dict[str, Any]:
    """Defaults, then the preset's values, then what is given and not None."""
    return _resolve(0, preset, DIGEST_DEFAULTS, given)


def predict_settings(preset: str = "none", **given: Any) -> dict[str, Any]:
    return _resolve(1, preset, PREDICT_DEFAULTS, given)


def table() -> list[dict[str, Any]]:
    return [{"preset": n, **digest_settings(n), **predict_settings(n)} for n in names()]
