"""Helpers for batches of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

#: Characters handled at once: bounds a worker's memory whatever the number of rows in a batch. A longer text is
#: handled alone.
CHUNK_CHARS = 2_000_000


def chunks(texts: Sequence[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of together at most `size` characters."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
