"""Errors of the public API."""

from __future__ import annotations


class ValidationError(ValueError):
    """Bad arguments or data: messages by field."""

    def __init__(self, messages: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in messages.items()))
        self.messages = messages


class Conflict(RuntimeError):
    """Another writer published a version first; nothing was changed, and the work can be done again on the new version."""


class NotFound(KeyError):
    """No vector has this id."""


def check_dimension(n: int | None, dim: int) -> None:
    if n != dim:
        raise ValidationError({"vector": f"incorrect vector dimension: {n}, required: {dim}"})


def check_count(k: int | None, default: int = 5) -> int:
    k = default if k is None else k
    if k <= 0:
        raise ValidationError({"count": "must be positive"})
    return k
