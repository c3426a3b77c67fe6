"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in SQL functions only.

Every source is dealt into blocks by a seeded hash, which permutes its documents.
A source's quota is an exact number of blocks: whole epochs, then the first blocks
of one more epoch, the last of them cut by a second hash digit, and where equal rows
share that digit by their number, so that the words meet the target.  A binary tree then splits the quotas of all sources among the
output shards: a node with half of the shards below it on the left draws from its
remaining blocks without replacement, so the left counts of all sources are
multivariate hypergeometric and add up exactly.  A shard's counts are disjoint
runs of each source's block order; its documents are shuffled locally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tritmarts.llm.tables import written

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
#: least blocks of a source, and blocks of a source for each shard
BLOCKS = 1024
BLOCKS_PER_SHARD = 4
#: the tree has at least this many levels, and 2 to that power shards; more if shards would pass SHARD_WORDS
LEVELS = 6
SHARD_WORDS = 8_000_000
SEED = 17
#: a plan of at most this many rows (sources x blocks) goes to every task; a larger one is joined
MAX_SENT_ROWS = 1 << 18


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, size, skey, spot, fine): the whole document, its words, a non-null form of its source, and its place.

    Spot (24 bits, of which a block is the low ones) and fine (60 bits inside a block) come from
    one digest of doc_id, size and text, so that only rows equal in all three share a place.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")),
                               F.col("size").cast("string"), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))))
    return (docs.select(F.struct("*").alias("row"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0))
                        .cast("long").alias("size"))
            .select("row", "size", F.coalesce(F.concat(F.lit("="), "row.source"), F.lit("")).alias("skey"),
                    digest.alias("digest"))
            .select("row", "size", "skey", F.conv(F.substring("digest", 1, 6), 16, 10).cast("int").alias("spot"),
                    F.conv(F.substring("digest", 7, 15), 16, 10).cast("long").alias("fine")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            ceiling: int = CEILING) -> DataFrame:
    """``sources`` (skey, source, source_size) with their target.

    Targets are weight x level up to the ceiling.  In rising order of ceiling per
    weight a source is capped as long as its ceiling is below its share of what
    the sources before it have left, which is where resharing ends.  One row a
    source is ordered here, not the documents.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    return (sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * ceiling)
            .withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(share)
                                  - F.coalesce(F.sum("cap").over(ahead), F.lit(0))) / F.sum("weight").over(rest))
            .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
            .withColumn("place", F.row_number().over(by_room))
            .withColumn("first_open", F.min_by(F.struct("place", "level"), F.when(F.col("open"), F.col("place")))
                        .over(all_rows))
            .withColumn("target", F.when(F.col("first_open").isNull() | (F.col("place") < F.col("first_open.place")),
                                         F.col("cap").cast("double"))
                        .otherwise(F.col("weight") * F.col("first_open.level")))
            .select("skey", "source", "source_size", "target"))


def _drawn(population: str, good: str, draws: str, uniform: str) -> str:
    """SQL of one exact hypergeometric draw by inversion of its distribution.

    Probabilities follow from each other by a ratio, so no factorials are needed.
    The support is cut ten standard deviations and ten blocks around the mean,
    outside of which lies less than a double can tell from 0.
    """
    mean = f"({draws} * {good} / greatest({population}, 1))"
    wide = (f"(10 + 10 * sqrt({mean} * (1 - {good} / greatest({population}, 1))"
            f" * ({population} - {draws}) / greatest({population} - 1, 1)))")
    low = f"greatest(0, {draws} - ({population} - {good}), cast(floor({mean} - {wide}) as bigint))"
    high = f"least({draws}, {good}, cast(ceil({mean} + {wide}) as bigint))"
    ratio = ("(z.good - x) * (z.draws - x) / ((x + 1D) * (z.population - z.good - z.draws + x + 1D))")
    total = f"aggregate(z.xs, struct(1D as w, 0D as t), (a, x) -> struct(a.w * {ratio} as w, a.t + a.w as t), a -> a.t)"
    pick = ("aggregate(y.z.xs, struct(1D as w, 0D as t, y.z.xs[0] as at), (a, x) -> struct("
            f"a.w * {ratio.replace('z.', 'y.z.')} as w, a.t + a.w as t,"
            " if(a.t + a.w <= y.z.uniform * y.total and x < y.z.high, x + 1, a.at) as at), a -> a.at)")
    bound = (f"named_struct('population', {population}, 'good', {good}, 'draws', {draws}, 'uniform', {uniform},"
             f" 'xs', sequence(cast({low} as bigint), cast({high} as bigint)), 'high', {high})")
    return f"transform(transform(array({bound}), z -> struct(z, {total} as total)), y -> {pick})[0]"


def _split(seed: int) -> Column:
    """Left quotas of a node (node, quotas): its sources draw in turn from the left half's remaining places."""
    uniform = f"pmod(xxhash64({seed}, node, i), 9007199254740992) / 9007199254740992D"
    return F.expr(f"""aggregate(sequence(0, size(quotas) - 1),
        named_struct('taken', cast(array() as array<bigint>),
               'draws', cast(aggregate(quotas, 0L, (s, q) -> s + q) / 2 as bigint),
               'population', aggregate(quotas, 0L, (s, q) -> s + q)),
        (state, i) -> transform(array({_drawn("state.population", "quotas[i]", "state.draws", uniform)}), got ->
            named_struct('taken', concat(state.taken, array(got)), 'draws', state.draws - got,
                         'population', state.population - quotas[i]))[0],
        state -> state.taken)""")


def splitting_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(skey, starts): for each source of ``quotas`` (skey, quota) the first draw of every shard, by shard.

    One row a node holds the counts of all sources; nodes split level by level.
    """
    nodes = (quotas.agg(F.array_sort(F.collect_list(F.struct("skey", "quota"))).alias("all")).where(F.size("all") > 0)
             .select(F.col("all.skey").alias("skeys"), F.col("all.quota").alias("quotas"), F.lit(1).cast("long").alias("node")))
    for _ in range(levels):
        nodes = (nodes.withColumn("left", _split(seed))
                 .select("skeys", F.explode(F.array(
                     F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
                     F.struct((F.col("node") * 2 + 1).alias("node"),
                              F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))).alias("half"))
                 .select("skeys", "half.quotas", "half.node"))
    counts = nodes.select("node", F.explode(F.arrays_zip("skeys", "quotas")).alias("c")).select(
        "node", F.col("c.skeys").alias("skey"), F.col("c.quotas").alias("n"))
    before = Window.partitionBy("skey").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("node", "start"))).alias("s"))
            .select("skey", F.col("s.start").alias("starts")))


def block_plan(narrow: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """One row per source and block: source_size, target, shards of its whole draws, and of its cut draw if any.

    ``narrow`` are documents with skey, source, block, fine and size.  Only sums
    per block (and per fine digit inside one block of each source) are ordered.
    The cut draw takes all rows up to the digit ``cut``, and ``tie_rows`` of the equal
    rows at the digit ``tie``.
    """
    blocks = written(narrow.groupBy("skey", "source", "block").agg(F.sum("size").alias("words")), "mix_blocks")
    goal = targets(blocks.groupBy("skey", "source").agg(F.sum("words").alias("source_size")))
    along = Window.partitionBy("skey").orderBy("block")
    placed = (blocks.drop("source").join(goal, "skey")
              .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
              .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
              .withColumn("pos", F.row_number().over(along) - 1)
              .withColumn("n_blocks", F.count("*").over(Window.partitionBy("skey")))
              .withColumn("ahead", F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")))
    placed = written(placed.withColumn("extra", F.when(F.col("ahead") + F.col("words") <= F.col("rest"), F.lit(2))
                                       .when((F.col("ahead") < F.col("rest")) & (F.col("words") > 0), F.lit(1)).otherwise(F.lit(0))),
                     "mix_placed")
    edge = placed.where("extra = 1").select("skey", "block", (F.col("rest") - F.col("ahead")).alias("missing"))
    fines = narrow.join(edge, ["skey", "block"]).groupBy("skey", "fine", "missing").agg(
        F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = Window.partitionBy("skey").orderBy("fine").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("missing") - F.sum("words").over(upto) + F.col("words")
    fits = F.when(F.col("words") > 0, F.floor(room * F.col("n") / F.col("words") + 0.5)).when(room >= 0, F.col("n")).otherwise(0)
    cuts = (fines.withColumn("fits", F.least(F.greatest(fits, F.lit(0)), "n")).where("fits > 0").groupBy("skey").agg(
        F.max(F.when(F.col("fits") == F.col("n"), F.col("fine"))).alias("cut"),
        F.max(F.when(F.col("fits") < F.col("n"), F.struct("fine", "fits"))).alias("tied")))
    quotas = placed.groupBy("skey").agg(F.sum(F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("long").alias("quota"))
    tree = splitting_tree(quotas, levels, seed)
    draw = F.transform(F.sequence(F.lit(0), F.col("epochs").cast("int")), lambda e: F.when(
        (e < F.col("epochs")) | (F.col("extra") > 0),
        F.size(F.filter("starts", lambda s: s <= e * F.col("n_blocks") + F.col("pos"))) - 1))
    return (placed.join(tree, "skey").join(cuts, "skey", "left").withColumn("draws", draw)
            .select("skey", "block", "source_size", "target",
                    F.expr("array_compact(slice(draws, 1, cast(epochs as int)))").alias("whole"),
                    F.expr("draws[cast(epochs as int)]").alias("last"),
                    F.when(F.col("extra") == 1, F.coalesce("cut", F.lit(-1))).alias("cut"),
                    F.when(F.col("extra") == 1, F.col("tied.fine")).alias("tie"), F.col("tied.fits").alias("tie_rows")))


def levels_for(words: int | None) -> int:
    """Levels of the tree for a mix of so many words."""
    return max(LEVELS, math.ceil(math.log2(max(1, (words or 0) * SHARE / SHARD_WORDS))))


def drawn(docs: DataFrame, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """(row, size, source_size, target, shards): ``shards`` has one output shard for each time the mix draws the row.

    A null text has size 0; null sources form one source, ordered last.  Rows that
    agree in doc_id and text are drawn together, but where the target falls between
    them: there as many of them are drawn as meet it, and which does not matter.
    Rows of size 0 are drawn like others and cost no words.
    """
    narrow = written(sized(docs, seed).select("skey", F.col("row.source").alias("source"), "spot", "fine", "size"),
                     "mix_sizes")
    levels = levels or levels_for(narrow.agg(F.sum("size").alias("words")).first().words)
    block = F.col("spot") % max(BLOCKS, min(1 << 24, BLOCKS_PER_SHARD << levels))
    plan = written(block_plan(narrow.withColumn("block", block), levels, seed), "mix_plan")
    few = plan.count() <= MAX_SENT_ROWS
    taken = F.when(F.col("last").isNotNull() & (F.col("cut").isNull() | (F.col("fine") <= F.col("cut"))),
                   F.concat("whole", F.array("last"))).otherwise(F.col("whole"))
    rows = sized(docs, seed).withColumn("block", block).join(F.broadcast(plan) if few else plan, ["skey", "block"])
    found = ["row", "size", "source_size", "target", taken.alias("shards")]
    if plan.where("tie is not null").isEmpty():
        return rows.select(*found)
    return rows.where(~F.col("fine").eqNullSafe(F.col("tie"))).select(*found).union(_of_ties(rows.where("fine = tie")))


def _of_ties(rows: DataFrame) -> DataFrame:
    """As ``drawn``, for the equal rows of each source of which only tie_rows are drawn once more.

    They are numbered inside the part that wrote them and behind the parts before it, so no task holds them all.
    """
    parts = written(rows.select("skey", "row", "size", "source_size", "target", "whole", "last", "tie_rows",
                                F.spark_partition_id().alias("part")), "mix_ties")
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy("skey", "part").count().select(
        "skey", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("skey", "part").orderBy("size"))
    return parts.withColumn("nth", inside).join(ahead, ["skey", "part"]).select(
        "row", "size", "source_size", "target",
        F.when(F.col("nth") + F.col("ahead") <= F.col("tie_rows"), F.concat("whole", F.array("last"))).otherwise(F.col("whole"))
        .alias("shards"))


def mixture(docs: DataFrame, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each draw, dealt to shards and shuffled inside them."""
    rows = drawn(docs, levels, seed).select("row", F.posexplode("shards").alias("nth", "shard"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.withColumn("place", F.xxhash64(F.lit(seed), "nth", "row.doc_id"))
            .repartition(max(2 ** LEVELS, parts), "shard").sortWithinPartitions("shard", "place").select("row.*"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the draws take of each row."""
    return drawn(docs.select(F.col("doc_id").cast("long"), "text", "source")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))
