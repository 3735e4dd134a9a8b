"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.session import written as materialize  # noqa: F401  a table written once, read by all that follows

# Fixed value: a word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# The letters that equality of texts ignores the case of.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold_case(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed (null: empty)."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


_HELD: dict = {}


def held_by_worker(key=None, make=None):
    """What a Python worker keeps between tasks: one object, of the operator that ran last.

    Workers are reused by all operators of a job; whichever starts with another key (or
    none) lets go of what the one before kept, so that memos don't add up.
    """
    if key not in _HELD:
        _HELD.clear()
        if make is not None:
            _HELD[key] = make()
    return _HELD.get(key)


def partitions_for(rows: int, per_task: int) -> int:
    """Tasks needed to keep each at about ``per_task`` rows."""
    return max(1, math.ceil(rows / per_task))
