"""Many patterns in one pass over a text: an Aho-Corasick automaton over Arrow batches.

A text is read once, however many patterns there are, where an expression of one `contains` a pattern reads it as often
as there are patterns. A task builds its automaton once. Patterns are literal and compared by code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of patterns in one automaton, which takes some fifty times that in memory.
MOST_BYTES = 4 << 20


class Patterns:
    """Literal patterns by number. The empty pattern is in every text."""

    def __init__(self, patterns: Sequence[str]):
        if (size := sum(len(p.encode()) for p in patterns)) > MOST_BYTES:
            raise ValueError(f"{size} bytes of patterns; an automaton is made for {MOST_BYTES} at most, so cut them into blocks")
        self.patterns = list(dict.fromkeys(patterns))

    def finder(self) -> Callable[[str], set[int]]:
        """A function from a text to the numbers of the patterns that it holds."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        always = {k for k, p in enumerate(self.patterns) if not p}
        for k, p in enumerate(self.patterns):
            if p:
                automaton.add_word(p, k)
        if not len(automaton):
            return lambda text: always
        automaton.make_automaton()
        return lambda text: {k for _, k in automaton.iter(text)} | always

    def found(self, text: Column) -> Column:
        """Of each text the sorted numbers of the patterns that it holds; null of null."""

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = self.finder()
            for texts in batches:
                yield pa.array([None if t is None else sorted(find(t)) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return run(text)

    def any(self, text: Column) -> Column:
        """Whether a text holds any of the patterns, up to the first; null of null."""

        @F.arrow_udf("boolean")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in self.patterns:
                if p:
                    automaton.add_word(p, 0)
            always = "" in self.patterns
            if len(automaton):
                automaton.make_automaton()
            hit = lambda t: always or (len(automaton) > 0 and next(automaton.iter(t), None) is not None)
            for texts in batches:
                yield pa.array([None if t is None else hit(t) for t in texts.to_pylist()], pa.bool_())

        return run(text)


class Lexicon:
    """Keywords by vector, vectors in an order of their own."""

    def __init__(self, keywords: dict[str, Sequence[str]]):
        self.keywords = {name: list(words) for name, words in keywords.items()}
        self.patterns = Patterns([w for words in self.keywords.values() for w in words])

    @classmethod
    def from_table(cls, rows: DataFrame, vector: str = "vector", keyword: str = "keyword", order: str = "position") -> Lexicon:
        """From a table with a row per keyword; vectors stand in the order of their first keyword. Its size is checked before it is read."""
        known = rows.where(F.col(vector).isNotNull() & F.col(keyword).isNotNull())
        size = known.agg(F.sum(F.octet_length(keyword)).alias("n")).first()["n"] or 0
        if size > MOST_BYTES:
            raise ValueError(f"{size} bytes of keywords; a lexicon has {MOST_BYTES} at most")
        out: dict[str, list[str]] = {}
        for r in known.select(F.col(vector).alias("v"), F.col(keyword).alias("k")).orderBy(order, vector, keyword).collect():
            out.setdefault(r.v, []).append(r.k)
        return cls(out)

    def hits(self, text: Column) -> Column:
        """How many of each vector's keywords are in the lower-case text, in the order of the vectors; a keyword listed twice counts twice."""
        of: list[list[tuple[int, int]]] = [[] for _ in self.patterns.patterns]
        number = {w: k for k, w in enumerate(self.patterns.patterns)}
        for v, words in enumerate(self.keywords.values()):
            for w in set(words):
                of[number[w]].append((v, words.count(w)))
        patterns, n = self.patterns, len(self.keywords)

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = patterns.finder()
            for texts in batches:
                rows = []
                for t in texts.to_pylist():
                    counts = [0] * n
                    for k in () if t is None else find(t):
                        for v, times in of[k]:
                            counts[v] += times
                    rows.append(counts)
                yield pa.array(rows, pa.list_(pa.int32()))

        return run(F.lower(text))

    def hits_of(self, hits: Column, vector: Column) -> Column:
        """The count of one vector out of `hits`; 0 for a vector that isn't in the lexicon."""
        at = F.array_position(self.names(), vector)
        return F.when(at > 0, F.element_at(hits, at.cast("int"))).otherwise(0)

    def names(self) -> Column:
        return F.array(*map(F.lit, self.keywords)) if self.keywords else F.array().cast("array<string>")
