"""Many literal patterns at once: one Aho-Corasick automaton for a list, built once in each task.

A text is read once whatever the number of patterns, by C code, and all hits come out; a list of alternations reads it once
for each list, and from every start of a match again. The automaton runs on Arrow batches. Patterns are fixed lists of a
profile, so it is small; it is built from the list itself, which travels with the function.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.names import text

HITS, SPANS = "array<int>", "array<struct<pattern:int,start:int,end:int>>"


def automaton(patterns: tuple[str, ...]):
    """The automaton of distinct, non-empty patterns, which are known by their places in the list."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        found.add_word(p, (i, len(p)))
    if patterns:
        found.make_automaton()
    return found


def _checked(patterns: Sequence[str]) -> tuple[str, ...]:
    if "" in patterns or len(set(patterns)) != len(patterns):
        raise ValueError("patterns must be distinct and not empty")
    return tuple(patterns)


def hits(column: Column, patterns: Sequence[str]) -> Column:
    """The numbers of the patterns that occur in a text, ascending; null counts as empty. Case counts."""
    words, built = _checked(patterns), {}

    def run(texts: pa.Array) -> pa.Array:
        if words and not built:
            built[0] = automaton(words).iter
        found = built.get(0)
        return pa.array([sorted({value[0] for _, value in found(t)}) if found and t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    # The annotations as objects, as a function that is sent by value resolves no names.
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, HITS)(text(column))


def spans(column: Column, patterns: Sequence[str], overlapping: bool = True) -> Column:
    """Every occurrence as (pattern, start, end) in code points, by end, then the longer first; or, not ``overlapping``, the
    leftmost-longest ones that do not meet, from left to right."""
    words, built = _checked(patterns), {}

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("pattern", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        if not words:
            return pa.array([[] for _ in range(len(texts))], kind)
        if not built:
            built[0] = automaton(words)
        found, told = built[0], []
        for t in texts.to_pylist():
            each = (found.iter(t) if overlapping else found.iter_long(t)) if t else ()
            told.append([{"pattern": i, "start": end + 1 - n, "end": end + 1} for end, (i, n) in each])
        return pa.array(told, kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SPANS)(text(column))


def any_hit(found: Column, numbers: Sequence[int]) -> Column:
    """Whether one of these patterns is among the hits."""
    return F.arrays_overlap(found, F.array(*map(F.lit, numbers))) if numbers else F.lit(False)
