"""Mixing sources to target weights by temperature.

Source token shares p are sharpened or flattened to w proportional to p ** alpha. Bisection finds the
exponent: the largest alpha in [0, 1] (the least change) whose weights reach the target entropy, or,
where the repetition limit would be broken there, the least alpha above it that keeps the limit. The
weights are realised as epochs: each source's documents are permuted anew in every epoch by a seeded
hash, whole epochs are taken while the source's token budget lasts, and the last epoch is cut where the
budget ends. The stream is cut into blocks; every block takes the same fraction of every source's
budget, so each block has the target weights, and the rows of a block are permuted by hash.

With budget_tokens None the budget is the least at which every source is used in full at least once, so
no document is dropped and the mix is made by repeating documents of the smaller sources.

Order within a source is never computed in one task: a permutation is hashed into cells, the cells'
tokens are summed, running totals are taken over the cells (their number is fixed for each source and
epoch), and rows are ranked inside one cell only: the one where a budget ends, divided further until it has at most MOST_RANKED rows.

A row's place follows from its doc_id and text, so a doc_id that many rows share (or null) spreads over the stream; rows that
repeat both are told apart by their place in the input. The driver holds a row for each source, at most MOST_SOURCES.

Defined results: a null source is a source of its own; null or empty text has 0 tokens, does not count
for the shares, and goes with its source's full epochs; sources without tokens are passed through once;
an empty table gives no rows; columns named like the output's own are replaced, all others are kept as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.session import materialise, shared_dir

CELL_BITS = 8
CELLS = 1 << CELL_BITS
#: Rows of one cell that are ranked in one task; more are divided into cells again.
MOST_RANKED = 50_000
#: Sources, each a row of the driver's plan; rows of cells up to which their table is broadcast.
MOST_SOURCES, SMALL_CELLS = 10_000, 1_000_000
OUTPUT = ("tokens", "epoch", "block", "position")


@dataclass(frozen=True)
class Plan:
    """alpha: exponent; weights and budgets (tokens) of each source; entropy: of the weights, in nats."""

    alpha: float
    entropy: float
    weights: dict[str | None, float]
    budgets: dict[str | None, float]


def tempered(shares: dict, alpha: float) -> dict:
    """Normalised p ** alpha."""
    raised = {s: math.exp(alpha * math.log(p)) for s, p in shares.items()}
    total = math.fsum(raised.values())
    return {s: x / total for s, x in raised.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def most_repeats(shares: dict, weights: dict) -> float:
    """How often the most repeated source is used while the least repeated one is used once."""
    ratio = [weights[s] / shares[s] for s in shares]
    return max(ratio) / min(ratio)


def bisect(test, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The largest x in [low, high] with test(x), for a test that holds up to some x; low if it never holds."""
    if test(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if test(mid) else (low, mid)
    return low


def plan(tokens: dict, entropy_share: float = 0.97, max_repeats: float = 4.0, budget_tokens: float | None = None) -> Plan:
    """tokens: of each source. entropy_share: target entropy as a share of log(sources)."""
    tokens = {s: n for s, n in tokens.items() if n > 0}
    total = sum(tokens.values())
    if not total:
        return Plan(1.0, 0.0, {}, {})
    shares = {s: n / total for s, n in tokens.items()}
    target = entropy_share * math.log(len(shares))
    alpha = bisect(lambda a: entropy(tempered(shares, a)) >= target - 1e-12)
    repeats = lambda a: most_repeats(shares, tempered(shares, a)) if budget_tokens is None else max(budget_tokens * w / tokens[s] for s, w in tempered(shares, a).items())
    if repeats(alpha) > max_repeats + 1e-9:
        alpha = 1.0 - bisect(lambda b: repeats(1.0 - b) <= max_repeats, 0.0, 1.0 - alpha)
    weights = tempered(shares, alpha)
    budget = budget_tokens if budget_tokens is not None else max(tokens[s] / w for s, w in weights.items())
    return Plan(alpha, entropy(weights), weights, {s: budget * w for s, w in weights.items()})


def token_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text: non-space characters that begin the text or follow a space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(t, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def mix(docs: DataFrame, entropy_share: float = 0.97, max_repeats: float = 4.0, budget_tokens: float | None = None, blocks: int = 64, seed: int = 7, carry: bool = True, path: str | None = None) -> DataFrame:
    """docs, each row as often as the mix uses it, with tokens long, epoch int (from 0), block int and position double.

    position orders the whole stream; a block is a range of it. A document is in an epoch whole or not at
    all: the one in which a source's budget ends is used. carry: keep the columns of docs, else only doc_id
    and source. path: where intermediate tables go; by default below the shared folder.
    """
    spark, path = docs.sparkSession, path or shared_dir(docs.sparkSession)
    own = [c for c in docs.columns if c not in OUTPUT] if carry else ["doc_id", "source"]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col("source").cast("string").alias("__s"), token_count(text).alias("__tokens"), F.xxhash64(F.col("doc_id"), text).alias("__key"))
    small = materialise(rows.drop("__row") if carry else rows, f"{path}/tokens")
    rows = rows if carry else small  # without the texts nothing is read twice
    again = small.groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1").select("__key", F.lit(True).alias("__again"))
    if not again.isEmpty():  # whole rows are written with their keys, as a place in the input is only good for one reading
        told = F.when(F.col("__again"), F.xxhash64("__key", F.monotonically_increasing_id())).otherwise(F.col("__key"))
        rows = materialise(rows.join(again, "__key", "left").withColumn("__key", told).drop("__again"), f"{path}/rows")
        small = rows.drop("__row")
    tokens = {r["__s"]: r["n"] for r in small.groupBy("__s").agg(F.sum("__tokens").alias("n")).limit(MOST_SOURCES + 1).collect()}  # a row for each source
    if len(tokens) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    made = plan(tokens, entropy_share, max_repeats, budget_tokens)
    uses = []
    for s, n in tokens.items():
        if not n:
            uses.append((s, 0, 0, 0, 1.0, True))
            continue
        budget = made.budgets[s]
        whole = int(budget / n + 1e-9)
        rest = int(round(budget - whole * n))
        uses += [(s, e, n, n, budget, True) for e in range(whole)]
        if rest > 0:
            uses.append((s, whole, n, rest, budget, False))
    plans = spark.createDataFrame(uses, "__ps string, __epoch int, __all long, __take long, __budget double, __whole boolean")
    bits = 63

    def dealt(some: DataFrame) -> DataFrame:
        some = some.join(F.broadcast(plans), F.col("__s").eqNullSafe(F.col("__ps"))).drop("__ps")  # a row for each source and epoch
        h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__key", "__epoch"), 1)
        return some.withColumn("__h", h).withColumn("__cell", F.shiftright("__h", bits - CELL_BITS))

    def at(other: DataFrame, *more: str) -> tuple[DataFrame, Column]:
        """other with its keys renamed, and the condition that they are a row's."""
        same = F.col("__s").eqNullSafe(F.col("__s_b"))
        for c in ("__epoch", *more):
            same = same & (F.col(c) == F.col(f"{c}_b"))
        return other.withColumnsRenamed({c: f"{c}_b" for c in ("__s", "__epoch", *more)}), same

    # running tokens before each cell of each permutation
    each = dealt(small)
    sums = each.groupBy("__s", "__epoch", "__cell").agg(F.sum("__tokens").alias("__held"), F.count("*").alias("__rows"), F.first("__whole").alias("__full"), F.first("__take").alias("__end"))
    running = F.sum("__held").over(W.partitionBy("__s", "__epoch").orderBy("__cell")) - F.col("__held")
    cells = materialise(sums.withColumn("__before", running), f"{path}/cells")
    crosses = (F.col("__before") < F.col("__end")) & (F.col("__before") + F.col("__held") > F.col("__end"))
    # the one cell of each cut epoch that the budget ends in, at most one for each source, as fine as it must be
    crossed, depth = cells.where(~F.col("__full") & crosses).select("__s", "__epoch", "__cell", "__before", "__end", "__rows"), CELL_BITS
    while depth + CELL_BITS <= bits - CELL_BITS and (crossed.agg(F.max("__rows")).first()[0] or 0) > MOST_RANKED:
        other, same = at(crossed.drop("__rows"), "__cell")
        finer = each.withColumn("__cell", F.shiftright("__h", bits - depth)).join(F.broadcast(other), same)
        depth += CELL_BITS
        finer = finer.withColumn("__cell", F.shiftright("__h", bits - depth)).groupBy("__s", "__epoch", "__cell", "__before", "__end").agg(F.sum("__tokens").alias("__held"), F.count("*").alias("__rows"))
        finer = finer.withColumn("__before", F.col("__before") + F.sum("__held").over(W.partitionBy("__s", "__epoch").orderBy("__cell")) - F.col("__held"))
        crossed = materialise(finer.where(crosses).select("__s", "__epoch", "__cell", "__before", "__end", "__rows"), f"{path}/crossed{depth}")
    other, same = at(crossed.select("__s", "__epoch", "__cell", "__before", "__end"), "__cell")
    ahead = F.coalesce(F.sum("__tokens").over(W.partitionBy("__s", "__epoch").orderBy("__h", "__key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = each.withColumn("__cell", F.shiftright("__h", bits - depth)).join(F.broadcast(other), same).withColumn("__ahead", ahead)
    ends = materialise(ranked.where("__before + __ahead < __end").groupBy("__s", "__epoch").agg(F.max("__h").alias("__last")), f"{path}/ends")
    held = F.broadcast if len(uses) * CELLS <= SMALL_CELLS else (lambda table: table)
    other, same = at(cells.select("__s", "__epoch", "__cell", "__held", "__before"), "__cell")
    placed = dealt(rows).join(held(other), same).drop("__s_b", "__epoch_b", "__cell_b")
    other, same = at(ends)
    placed = placed.join(F.broadcast(other), same, "left")
    used = F.col("__whole") | (F.col("__before") + F.col("__held") <= F.col("__take")) | ((F.col("__before") < F.col("__take")) & (F.col("__h") <= F.col("__last")))
    # the share of the source's budget that lies before the row: its cell's start and a hashed place inside the cell
    inside = F.pmod(F.col("__h"), F.lit(1 << 20)) / float(1 << 20)
    start = (F.col("__epoch") * F.col("__all") + F.col("__before") + inside * F.col("__held")) / F.col("__budget")
    share = F.least(F.lit(1.0 - 2.0**-40), F.when(F.col("__all") > 0, start).otherwise(inside))
    block = F.floor(share * blocks).cast("int")
    place = (F.col("block") + F.pmod(F.xxhash64(F.lit(seed + 1), "__key", F.col("epoch")), F.lit(1 << 30)) / float(1 << 30)) / blocks
    out = placed.where(used).select("__row", F.col("__tokens").alias("tokens"), F.col("__epoch").alias("epoch"), block.alias("block"), "__key")
    return out.select("__row.*", "tokens", "epoch", "block", place.alias("position"))
