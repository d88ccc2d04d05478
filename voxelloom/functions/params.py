"""Nested parameters: defaults, per-phase sections, list values."""

from __future__ import annotations


def deep_merge(base: dict, over: dict | None) -> dict:
    """`over` on top of `base`; nested sections merge, None keeps the base value."""
    out = dict(base)
    for key, value in (over or {}).items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = deep_merge(out[key], value)
        elif value is not None or key not in out:
            out[key] = value
    return out


def phase_steps(config: dict, phase: str, steps: str | None = None) -> list[str]:
    """Steps of a phase: the comma list when given, else those of the config."""
    if steps:
        return [s.strip() for s in steps.split(",") if s.strip()]
    return list(config.get(phase, {}).get("steps", []))


def step_params(config: dict, phase: str, step: str) -> dict:
    """Top-level section of a step with the section of the phase merged over it."""
    return deep_merge(config.get(step) or {}, config.get(phase, {}).get(step))


def parse_vector(text: str | None) -> list[float] | None:
    """'x,y,z' -> [z, y, x]; None or '' -> None."""
    if not text:
        return None
    return [float(v) for v in text.split(",")][::-1]
