"""Secret scans: trigram index for candidates, then the patterns themselves, in SQL functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tritmarts.llm.tables import row_key
from tritmarts.llm.trigrams import TrigramIndex


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: matches whose ``group`` is shorter than ``least`` characters are dropped
    group: int = 0
    least: int = 0


#: The first three are the base kinds.  A run of 24 or more and a run cut to 24 or more are the same spans, so the
#: length stands in the pattern wherever a failing match could not have hidden a later one.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = 3
MARK = "[REDACTED]"
_SPAN = "struct<start:int,kind_no:int,end:int>"


def _spans(rule: Rule, no: int, text: Column) -> Column:
    """Spans of one rule in code points: lengths of what lies between matches and of the matches, added up."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(F.transform(between, F.length).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.struct(begin.cast("int").alias("start"), F.lit(no).alias("kind_no"), end.cast("int").alias("end"))
        keep = pair["hit"].isNotNull()
        if rule.least:
            keep = keep & (F.length(F.regexp_extract(pair["hit"], rule.pattern, rule.group)) >= rule.least)
        return F.struct(end.cast("int").alias("at"),
                        F.when(keep, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda s: s["found"])).otherwise(start["found"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, spans): the whole document and its array of (start, kind_no, end) by start, then kind, then end.

    A null text is scanned as an empty one.  Rows that share doc_id and text are
    scanned each and get the same spans.  Rules whose query has no mandatory
    trigram are run on every text, the others on the candidates of the index only.
    """
    index = TrigramIndex({r.kind: r.pattern for r in rules})
    hits = index.candidates(index.postings(docs, "text", "doc_id", "text"))
    text = F.coalesce("row.text", F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    found = [F.when(F.array_contains("kinds", r.kind) if index.queries[r.kind] else text.rlike(r.pattern),
                    _spans(r, i, text)).otherwise(none) for i, r in enumerate(rules)]
    return (docs.select(row_key("doc_id", "text").alias("key"), F.struct("*").alias("row")).join(hits, "key", "left")
            .select("row", F.array_sort(F.concat(*found)).alias("spans")))


def written_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row of ``docs``."""
    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")

    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    return scan(docs.select(F.col("doc_id").cast("long"), "text")).select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans are replaced together, null texts stay null."""
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(state: Column, span: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                        F.when(span["start"] >= state["at"], F.concat(state["text"], kept, F.lit(mark)))
                        .otherwise(state["text"]).alias("text"))

    done = F.aggregate("spans", start, step,
                       lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") > 0, done).otherwise(text)
    return scan(docs).select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
