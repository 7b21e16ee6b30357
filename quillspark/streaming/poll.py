"""Following the sources: sync again and again, and hand on what changed. Deletions and edits are seen as well as additions, which a file stream isn't able to."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..engine import Engine, SyncReport


def follow(engine: Engine, on_change: Callable[[SyncReport], None], interval: float = 1.0, rounds: int | None = None) -> int:
    """Calls on_change after each round that changed something; gives the number of rounds."""
    done = 0
    while rounds is None or done < rounds:
        report = engine.sync()
        if report.changed:
            on_change(report)
        done += 1
        if rounds is None or done < rounds:
            time.sleep(interval)
    return done
