"""One memo of words at a time in a Python worker.

Workers live on from one operator to the next.  A memo that is claimed empties the one that was
claimed before, so a worker holds the largest of them and never their sum.
"""

from __future__ import annotations

_held: dict | None = None


def claim(memo: dict) -> None:
    global _held
    if _held is not memo:
        if _held is not None:
            _held.clear()
        _held = memo
