"""Secrets out of texts: as a column, and in the driver's log."""

from __future__ import annotations

import logging
import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what stands for a secret.
REDACTED = "***REDACTED***"


def _known(secrets: Sequence[str | None]) -> list[str]:
    """Secrets that are not empty, longer ones first, so that none is cut by another that it holds."""
    return sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))


def redacted(text: Column, secrets: Sequence[str | None]) -> Column:
    """The text with every known secret replaced; null stays null. Plain replacement, nothing is read as a pattern."""
    for secret in _known(secrets):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text


def redact(text: str, secrets: Sequence[str | None]) -> str:
    """The same for one string on the driver."""
    for secret in _known(secrets):
        text = text.replace(secret, REDACTED)
    return text


class RedactingFormatter(logging.Formatter):
    """Lays a record out as usual, then takes the secrets out of the whole line, arguments and traceback included."""

    def __init__(self, secrets: Sequence[str | None], layout: str = "%(asctime)s %(levelname)s %(name)s %(message)s"):
        super().__init__(layout)
        self.secrets = _known(secrets)

    def format(self, record: logging.LogRecord) -> str:
        """One line of the log."""
        return redact(super().format(record), self.secrets)


def driver_log(secrets: Sequence[str | None] = (), level: int = logging.INFO, stream: TextIO | None = None) -> logging.Logger:
    """The library's logger with a single handler that knows the secrets."""
    log = logging.getLogger("lectern")
    log.handlers.clear()
    log.addHandler(logging.StreamHandler(stream or sys.stderr))
    log.handlers[0].setFormatter(RedactingFormatter(secrets))
    log.setLevel(level)
    log.propagate = False
    return log
