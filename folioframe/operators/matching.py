"""Many patterns in many texts: one pass over each text, whatever the number of patterns.

The patterns of a mapping (the driver parsed it; their number and bytes are bounded) become one
Aho-Corasick automaton a worker, and a dictionary for those that must equal a whole text. Texts
never move, no row meets a pattern that it does not hold, and nothing is compared twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as T

MAX_PATTERNS, MAX_BYTES = 10_000, 16 << 20


def folded(c: Column) -> Column:
    """Case and outer blanks aside."""
    return F.lower(T.trim_unicode(c))


class Finder:
    """Which patterns a text holds, or equals."""

    def __init__(self, parts: dict[str, list[int]], wholes: dict[str, list[int]]):
        self.wholes, self.parts = wholes, ahocorasick.Automaton() if parts else None
        for pattern, numbers in parts.items():
            self.parts.add_word(pattern, numbers)
        if parts:
            self.parts.make_automaton()

    def __call__(self, text: str | None) -> list[int] | None:
        if not text:
            return None
        found = set(self.wholes.get(text, ()))
        if self.parts is not None:
            seen = {id(x): x for _, x in self.parts.iter(text)}
            found.update(*seen.values())
        return sorted(found) or None


def finder(patterns: dict[int, tuple[str, bool]]):
    """patterns (number -> pattern, whether the text must equal it) -> a function of a text column: the numbers of those it says, null for none.

    Case and outer blanks aside; an empty pattern or text never matches.
    """
    parts: dict[str, list[int]] = {}
    wholes: dict[str, list[int]] = {}
    for number, (pattern, exact) in patterns.items():
        if pattern:
            (wholes if exact else parts).setdefault(pattern, []).append(number)
    if len(patterns) > MAX_PATTERNS or sum(len(p.encode()) for p, _ in patterns.values()) > MAX_BYTES:
        raise ValueError(f"at most {MAX_PATTERNS} patterns of {MAX_BYTES} bytes in all")

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        said = Finder(parts, wholes)
        for texts in batches:
            yield texts.map(said, na_action="ignore").astype(object)

    return lambda text: find(folded(text))


def matched(rows: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """rows with every statement of asked (rid, selector, exact, more) that their text says, a row each; an equi-join on rid."""
    patterns = {r["rid"]: (r["said"], r["exact"]) for r in asked.select("rid", folded(F.col("selector")).alias("said"), "exact").collect()}  # as many as the mapping has
    if not patterns:
        return rows.where("false").join(asked, F.lit(True))
    return rows.withColumn("rid", F.explode(finder(patterns)(F.col(text)))).join(F.broadcast(asked), "rid")  # bounded by finder
