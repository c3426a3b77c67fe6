"""Boolean trigram queries of regular expressions, and the inverted index that answers them."""

from __future__ import annotations

from functools import reduce
from itertools import product
from re import _constants as C, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.llm.tables import row_key, written

#: alternatives followed side by side, and characters of a class that are spelled out
MAX_STRINGS = 64
MAX_CLASS = 6
#: bits of one long that hold postings of a row
WORD = 63

#: a query is an AND of clauses, a clause an OR of terms, a term a set of trigrams that must all occur
Query = list[list[frozenset[str]]]


def _terms(strings: set[str]) -> list[frozenset[str]] | None:
    """The clause of a set of literal alternatives; None if some alternative has no trigram."""
    terms = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in terms:
        return None
    return sorted((t for t in terms if not any(o < t for o in terms)), key=sorted)


def _alternatives(item, value) -> set[str] | None:
    """All strings of one parsed item if they are few, lower-cased; None if not."""
    if item is C.LITERAL:
        return {chr(value).lower()}
    if item is C.IN:
        out: set[str] = set()
        for kind, x in value:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < MAX_CLASS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= MAX_CLASS else None
    if item is C.SUBPATTERN:
        return _joined(value[3])
    if item is C.BRANCH:
        parts = [_joined(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if item is C.MAX_REPEAT and value[1] <= 3:
        once = _joined(value[2])
        if once is None:
            return None
        return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)}
    return {""} if item is C.AT else None


def _joined(items) -> set[str] | None:
    out = {""}
    for item, value in items:
        more = _alternatives(item, value)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> Query:
    """Clauses that every text with a match satisfies, over its lower-cased trigrams; empty: nothing is mandatory."""
    clauses: Query = []
    open_strings = {""}

    def close() -> None:
        nonlocal open_strings
        if (terms := _terms(open_strings)) and terms not in clauses:
            clauses.append(terms)
        open_strings = {""}

    def walk(items) -> None:
        nonlocal open_strings
        for item, value in items:
            more = _alternatives(item, value)
            if more is not None and len(open_strings) * len(more) <= MAX_STRINGS:
                open_strings = {a + b for a in open_strings for b in more}
                continue
            close()
            if item is C.SUBPATTERN:
                walk(value[3])
                close()
            elif item is C.MAX_REPEAT and value[0]:
                walk(value[2])
                close()

    walk(parser.parse(pattern))
    close()
    return clauses


class TrigramIndex:
    """Postings (trigram number, row key) of the trigrams that a set of patterns asks for."""

    def __init__(self, patterns: dict[str, str]):
        self.queries = {kind: trigram_query(p) for kind, p in patterns.items()}
        self.trigrams = sorted({t for q in self.queries.values() for c in q for term in c for t in term})
        self.number = {t: i for i, t in enumerate(self.trigrams)}

    def postings(self, docs: DataFrame, text: str, *key: str) -> DataFrame:
        """Written postings, ordered by trigram inside each file; a row's text is read once and not moved."""
        lowered = docs.select(row_key(*key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
        found = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(self.trigrams)])
        rows = lowered.select("key", F.explode(F.array_compact(found)).alias("trigram"))
        return written(rows.sortWithinPartitions("trigram"), "postings")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(key, kinds) of the rows whose intersected postings satisfy the query of at least one kind."""
        words = range(-(-len(self.trigrams) // WORD))
        bits = [F.bit_or(F.when(F.floor(F.col("trigram") / WORD) == w,
                                F.expr(f"shiftleft(1L, trigram % {WORD})")).otherwise(F.lit(0).cast("long")))
                .alias(f"bits{w}") for w in words]
        kinds = F.array_compact(F.array(*[F.when(self._holds(q), F.lit(k)) for k, q in self.queries.items() if q]))
        return (postings.groupBy("key").agg(*bits).select("key", kinds.alias("kinds")).where(F.size("kinds") > 0))

    def _holds(self, query: Query) -> Column:
        return reduce(Column.__and__, [reduce(Column.__or__, [self._all(t) for t in clause]) for clause in query])

    def _all(self, term: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for t in term:
            word, bit = divmod(self.number[t], WORD)
            masks[word] = masks.get(word, 0) | 1 << bit
        return reduce(Column.__and__, [F.col(f"bits{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in sorted(masks.items())])
