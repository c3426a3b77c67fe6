"""How the word use of sources of one language diverges, by sparse row accumulation.

Terms that a group (language, source) has are a sparse row; the index holds, term
by term, the groups that have it.  A group's row is accumulated at once: its terms
are looked up in the index and their divergences are added into one dense array
over its peers, so no pair of postings is ever a row of a table.

Every kept term counts, also those that neither group has.  A group without a term
has its baseline p0 there, so the array starts from the sum over all terms at the
baselines, is corrected for the terms of the group and for those of the peer (both
from their counts of counts), and the index adds what terms of both change.

Work is dealt by (language, strip of groups, block of terms): a tile accumulates the
rows of its groups over its terms, and the tiles' arrays are added up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tritmarts.llm.tables import in_small_batches, written

SCALE = 1_000_000_000
#: documents of a language that a kept term is in, and ranks of terms that are told
MIN_DOCS, TOP_TERMS = 3, 200
#: cells of the index in a block of terms, and groups of a language in a strip
BLOCK_CELLS, STRIP_GROUPS = 500_000, 512
#: all of a character outside ASCII are bytes from 80 on, and lower() of bytes changes A to Z only
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_SLICE = 1 << 20
_ROWS_OUT = 20_000


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` in slices that end between terms, so that only the terms of one slice are listed at once."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        term = _TERM.match(text, end)
        end = term.end() if term else end
        yield text[at:end]
        at = end


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64()}
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for i, (lang, source, text) in enumerate(zip(*(batch.column(k) for k in range(3))), 1):
            seen: Counter[bytes] = Counter()
            for part in _slices(text.as_buffer().to_pybytes()):
                seen.update(_TERM.findall(part.lower()))
            for column, values in zip(out, ([lang.as_py()] * len(seen), [source.as_py()] * len(seen), seen.keys(), seen.values())):
                column += values
            if len(out[3]) >= _ROWS_OUT or i == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds.values())], list(kinds))
                out = [[], [], [], []]


def term_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, first) of the kept terms: those in at least ``min_docs`` documents of the language.

    A document gives each of its terms once, with its count; all else is sums.
    ``first`` holds in one row of each term.
    """
    found = in_small_batches(docs).select("lang", "source", "text").mapInArrow(
        _term_rows, "lang string, source string, term string, n long")
    cells = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (cells.withColumn("in_docs", F.sum("docs").over(of_term)).where(F.col("in_docs") >= min_docs)
            .withColumn("first", F.col("source") == F.min("source").over(of_term)).select("lang", "term", "source", "n", "first"))


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / whole), exact while ``whole`` is below 2**53: three digits at a time."""
    digits, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        digits = digits * 1000 + more
    return digits + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tile(top_terms: int):
    names = ["lang", "source", "part", "item", "value"]

    def run(cells: pa.Table, groups: pa.Table) -> pa.Table:
        """Arrays of the groups of one strip over the terms of one block; ``groups`` are all of the language."""
        peers = groups.column("source").to_pylist()
        mine = np.flatnonzero(groups.column("mine").to_numpy())
        kept = groups.column("terms")[0].as_py()
        whole = np.maximum(groups.column("total").to_numpy() + kept, 1)
        base = shares(np.zeros_like(whole), whole)

        coded = cells.column("term").combine_chunks().dictionary_encode()
        words = coded.dictionary
        order = np.empty(len(words), np.int64)
        order[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        term = order[coded.indices.to_numpy()]
        source = pc.index_in(cells.column("source"), value_set=groups.column("source").combine_chunks()).to_numpy().astype(np.int64)
        words = words.to_numpy(zero_copy_only=False)[np.argsort(order)]
        by_term = np.argsort(term, kind="stable")
        term, source, n = term[by_term], source[by_term], cells.column("n").to_numpy()[by_term]
        p = shares(n, whole[source])
        start = np.searchsorted(term, np.arange(len(words) + 1))
        in_lang = np.add.reduceat(n, start[:-1]) if len(n) else n
        usual = shares(in_lang, max(groups.column("lang_total")[0].as_py() + kept, 1))
        by_source = np.argsort(source, kind="stable")
        row = np.searchsorted(source[by_source], np.arange(len(peers) + 1))

        # terms of the peer: what its counts change against the groups of the strip at their baselines
        counts = [np.unique(p[by_source[a:b]], return_counts=True) for a, b in zip(row, row[1:])]
        of_peer = np.zeros((len(mine), len(peers)), np.int64)
        for peer, (share, times) in enumerate(counts):
            of_peer[:, peer] = (_gap(base[mine, None], share[None, :]) * times).sum(1) - _gap(base[mine], base[peer]) * times.sum()

        first, lang = groups.column("first_block")[0].as_py(), groups.column("lang")[0].as_py()
        out: list[list] = [[], [], [], []]
        for me, of_peers in zip(mine.tolist(), of_peer):
            level = _gap(base[me], base)
            share, times = counts[me]
            sums = of_peers + (level * kept if first else 0) - level * times.sum()
            sums += (_gap(share[:, None], base[None, :]) * times[:, None]).sum(0)
            at = by_source[row[me]:row[me + 1]]
            if len(at):
                t, mine_p = term[at], p[at]
                width = start[t + 1] - start[t]
                ends = np.cumsum(width)
                posting = np.arange(ends[-1]) - np.repeat(ends - width - start[t], width)
                peer, far, near = source[posting], p[posting], np.repeat(mine_p, width)
                np.add.at(sums, peer, _gap(near, far) - _gap(near, base[peer]) - _gap(base[me], far) + level[peer])
                over = np.flatnonzero(mine_p > usual[t])
                value = _gap(mine_p[over], usual[t[over]])
                best = over[np.lexsort((t[over], -value))[:top_terms]]
                out[0] += [peers[me]] * len(best)
                out[1] += ["term"] * len(best)
                out[2] += list(words[t[best]])
                out[3].append(_gap(mine_p[best], usual[t[best]]))
            others = np.arange(len(peers)) != me
            out[0] += [peers[me]] * (len(peers) - 1)
            out[1] += ["pair"] * (len(peers) - 1)
            out[2] += [s for s, other in zip(peers, others) if other]
            out[3].append(sums[others])
        values = np.concatenate(out[3]) if out[3] else np.empty(0, np.int64)
        return pa.table([pa.array([lang] * len(values), pa.string()), *[pa.array(c, pa.string()) for c in out[:3]],
                         pa.array(values, pa.int64())], names=names)

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_cells: int = BLOCK_CELLS,
          strip_groups: int = STRIP_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of ``docs``.

    Part "pair": every other source of the language and the group's divergence from
    it over all kept terms.  Part "term": the group's terms that stand out from the
    language, the ``top_terms`` first.  Null text, lang and source are empty; every row is a
    document, repeated or not; groups without terms are compared too, by their
    baselines; a language without kept terms gives zeros; an empty table gives no row.
    Other columns are not read.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    index = written(term_index(read, min_docs), "term_index")
    blocks = max(1, -(-index.count() // block_cells))
    of_lang = index.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    sizes = read.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(
        index.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    strips = sizes.groupBy("lang").agg(F.ceil(F.count("*") / strip_groups).cast("int").alias("strips"))
    groups = written(sizes.join(of_lang, "lang", "left").join(strips, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
        F.coalesce("lang_total", F.lit(0)).alias("lang_total"), "strips"), "term_groups")

    def in_strips(df: DataFrame) -> DataFrame:
        return df.withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))

    cells = in_strips(index.join(groups.select("lang", "strips").distinct(), "lang")).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    peers = (in_strips(groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .withColumn("mine", F.pmod(F.xxhash64("source"), F.col("strips")) == F.col("strip"))
             .withColumn("first_block", F.col("block") == 0))
    key = ["lang", "strip", "block"]
    sums = (cells.select(*key, "term", "source", "n").groupBy(*key).cogroup(peers.drop("strips").groupBy(*key))
            .applyInArrow(_tile(top_terms), "lang string, source string, part string, item string, value long")
            .groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    return (sums.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' OR rank <= {top_terms}")
            .select("lang", "source", "part", "item", "value", "rank"))
