"""Reports from an external language model, with a deterministic stand-in."""

from __future__ import annotations

import logging
from collections.abc import Callable

log = logging.getLogger(__name__)


def narrative(prompt: str, label: str, p: float, call: Callable[[str], str] | None = None) -> str:
    """The model's answer to ``prompt``; without a model, or when it fails, a placeholder."""
    if call is not None:
        try:
            return call(prompt)
        except Exception as why:  # a remote client may fail in any way; the report still appears
            log.warning("no report from the model: %s", why)
    return f"Regime {label} with probability {p * 100:.1f}%. No narrative model is configured."
