"""The retry policy of extraction and persistence.

A document's groups of chunks are tried in order. Success moves the cursor and clears the attempt; a failure that can
be retried waits and tries again, up to MOST times; then, or at a fatal failure, every chunk of the group is recorded
as failed and the cursor moves on.
"""

from __future__ import annotations

import random

from ..functions.text import FATAL

MOST = 4
BASE, CAP = 2.0, 60.0


def retryable(message: str | None) -> bool:
    """Whether another try may help: of every error but the fatal ones, known or not."""
    low = (message or "").lower()
    return not any(k in low for k in FATAL)


def delay(attempt: int, rng: random.Random | None = None) -> float:
    """Seconds to wait before a try: exponential, capped, with up to half a second of jitter."""
    return min(BASE**attempt, CAP) + (rng or random).uniform(0, 0.5)
