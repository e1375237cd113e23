"""What the tests of the dictionary share."""

from __future__ import annotations

from collections import Counter


def bag(df):
    """Rows as a multiset, columns by name, so that order does not matter."""
    names = sorted(df.columns)
    return Counter(tuple(row[n] if not isinstance(row[n], list) else tuple(row[n]) for n in names) for row in df.collect())
