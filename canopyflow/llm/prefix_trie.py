"""Prefix trie of conversations: every distinct opening is a node, found by search and summed up by chains.

1. Turns are numbered by a global sort (range partitions, numbered in place; a conversation that spans partitions
   takes over the count of those before), so a conversation of any length is spread over tasks.
2. Every conversation is rebuilt: the first turns of its base conversation, then its own later turns. The digest of the
   first d turns is the XOR of 128-bit hashes of (position, role, text), a running fold in blocks of BLOCK turns.
3. The minima table has a row for each digest: its smallest member, its members, the last turn's bytes. A conversation that is the
   smallest member of a prefix is so for every longer one. It owns those: a chain of nodes. The first owned depth is found
   by a binary search whose steps are batched joins of (digest, conversation) with (digest, minimum), so no request is hot:
   first over the ends of blocks, then within one block.
4. A chain hangs below the node just above its first owned depth; that node's owner is looked up by its digest. So owned
   chains form the tree. Totals go bottom-up over chains: by doubling, each chain's sum passes to its ancestors at distance 1, 2, 4, ...
   in as many rounds as the logarithm of the tree's height, and then to the nodes as a fold along each chain.
5. Ids of the conversations that end in a node are sorted by range, joined to pieces, and hashed piece by piece in order.

Defined results: rows with a null conv_id are left out; null role or text is the empty string; turns are ordered by turn, null first, ties by a
hash of role and text, and repeated rows are turns of their own; conversations without rebuilt turns are members of the
root; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.llm.folds import pick
from canopyflow.llm.near_dedup import _spread_join
from canopyflow.session import materialise, shared_dir

#: Turns of one conversation that a task holds in one row or one window.
BLOCK = 1024
#: The most turns that a conversation takes over, plus one.
LEADS = 9


def _hashes(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *reversed(columns))]


def numbered_turns(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, pos (from 0), t1 and t2 (hashes of role and text), bytes of the text."""
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = _hashes(role, text)
    rows = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long"), "turn", t1.alias("t1"), t2.alias("t2"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2", "copy"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, opening, last, seen = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            conv, n = batch.column(0).to_numpy(zero_copy_only=False), batch.num_rows
            if not n:
                continue
            opening = conv[0] if opening is None else opening
            begin = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            local = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
            if last == conv[0]:
                local[: begin[1] if len(begin) > 1 else n] += seen
            last, seen = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, pid)), pa.array(local), pa.array(conv == opening), *(batch.column(c) for c in (2, 3, 4))],
                names=["conv_id", "pid", "local", "opens", "t1", "t2", "bytes"],
            )

    here = materialise(dealt.mapInArrow(each, "conv_id long, pid long, local long, opens boolean, t1 long, t2 long, bytes long"), f"{path}/turns")
    # only a conversation that opens a partition can have begun before it: at most one for each partition
    spread = F.broadcast(here.where("opens").groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id"))
    counts = here.join(spread, "conv_id", "left_semi").groupBy("conv_id", "pid").agg((F.max("local") + 1).alias("n"))
    before = counts.select("conv_id", "pid", F.sum("n").over(W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)).alias("before")).where("before > 0")
    return here.join(F.broadcast(before), ["conv_id", "pid"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


def running(rows: DataFrame, key: str, fold, join, names: list[str], back: bool = False) -> DataFrame:
    """The columns `names` replaced by their folds from the first depth of each key on (from the last, if back), BLOCK depths a window."""
    way = F.desc if back else F.asc
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    inner = W.partitionBy(key, "block").orderBy(way("depth")).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(key).orderBy(way("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy(key, "block").agg(*[fold(n).alias(n) for n in names], F.lit(1).alias("one"))
    carry = whole.select(key, "block", *[fold(n).over(outer).alias(f"{n}_before") for n in names], F.sum("one").over(outer).alias("blocks")).where("blocks > 0").drop("blocks")
    local = rows.withColumns({n: fold(n).over(inner) for n in names}).join(carry, [key, "block"], "left")
    return local.withColumns({n: join(F.col(n), F.coalesce(f"{n}_before", F.lit(0))) for n in names}).drop(*[f"{n}_before" for n in names])


def prefixes(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, depth (from 0), length (of the conversation), x1 and x2 (digest), p1 and p2 (digest of one turn less), bytes, block."""
    sizes = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    leads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADS
    sizes = sizes.select("conv_id", "n", leads.alias("leads"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = sizes.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = sizes.join(bases, "base", "left").withColumn("lead", F.least("leads", F.coalesce("n_base", F.lit(0))))
    convs = convs.select("conv_id", "base", "leads", "lead", "n", (F.col("lead") + F.greatest(F.col("n") - F.col("leads"), F.lit(0))).alias("length"))
    convs = materialise(convs, f"{path}/convs")
    opening = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") < LEADS - 1)).withColumnRenamed("conv_id", "base")
    opening = opening.join(convs.select("base", "conv_id", "leads", "length"), "base").where("pos < leads").select("conv_id", "length", (F.col("pos") + 1).alias("depth"), "t1", "t2", "bytes")
    own = _spread_join(turns, convs.select("conv_id", "leads", "lead", "length", "n"), ["conv_id"], "n", max(1000, convs.count() // 1000)).where("pos >= leads")
    own = own.select("conv_id", "length", (F.col("lead") + F.col("pos") - F.col("leads") + 1).alias("depth"), "t1", "t2", "bytes")
    rebuilt = opening.unionByName(own)
    i1, i2 = _hashes(F.col("depth"), F.col("t1"), F.col("t2"))
    items = rebuilt.select("conv_id", "length", "depth", "bytes", i1.alias("i1"), i2.alias("i2"))
    root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("i1"), F.lit(0).cast("long").alias("i2"))
    items = items.unionByName(root).withColumns({"x1": F.col("i1"), "x2": F.col("i2")})
    found = running(items, "conv_id", F.bit_xor, lambda a, b: a.bitwiseXOR(b), ["x1", "x2"])
    found = found.select("conv_id", "depth", "length", "x1", "x2", F.col("x1").bitwiseXOR(F.col("i1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("i2")).alias("p2"), "bytes", "block")
    return materialise(found, f"{path}/prefixes")


def first_owned(steps: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """conv_id, first (depth), p1, p2 (digest above) of every conversation that is the smallest member of one of its prefixes."""
    owned = nodes.select("x1", "x2", "depth", F.col("conv_id"), F.lit(True).alias("yes"))
    blocks = steps.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("depth", "x1", "x2", "p1", "p2"))).alias("steps"))
    blocks = materialise(blocks, f"{path}/blocks")
    longest = blocks.agg(F.max(F.size("steps"))).first()[0] or 0

    def ask(rows: DataFrame, at: Column) -> DataFrame:
        asked = rows.withColumns({"x1": at["x1"], "x2": at["x2"], "depth": at["depth"]})
        return asked.join(owned, ["x1", "x2", "depth", "conv_id"], "left").drop("x1", "x2", "depth")

    ends = ask(blocks.select("conv_id", "block", F.element_at("steps", -1).alias("end")), F.col("end")).where("yes")
    state = ends.groupBy("conv_id").agg(F.min("block").alias("block")).join(blocks, ["conv_id", "block"])
    state = state.select("conv_id", "steps", F.lit(0).alias("lo"), (F.size("steps") - 1).alias("hi"))
    for _ in range(max(0, longest - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        state = ask(state.withColumn("mid", mid), F.get("steps", F.col("mid")))
        yes = F.coalesce("yes", F.lit(False))
        lo = F.when(yes, F.col("lo")).otherwise(F.least(F.col("mid") + 1, F.col("hi")))
        state = state.select("conv_id", "steps", lo.alias("lo"), F.when(yes, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    top = F.get("steps", F.col("hi"))
    return materialise(state.select("conv_id", top["depth"].alias("first"), top["p1"].alias("p1"), top["p2"].alias("p2")), f"{path}/first")


def chain_totals(chains: DataFrame, path: str) -> DataFrame:
    """conv_id, saved, leaves: each chain's values summed with those of all chains below it, by doubling."""
    state, step = materialise(chains.select("conv_id", F.col("parent").alias("up"), "saved", "leaves"), f"{path}/totals0"), 0
    while not (open_rows := state.where("up is not null")).isEmpty():
        more = open_rows.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        further = open_rows.select("conv_id", "up").join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up").where("next is not null").select("conv_id", "next")
        state = state.join(more, "conv_id", "left").join(further, "conv_id", "left")
        state = state.select("conv_id", F.col("next").alias("up"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
        step += 1
        state = materialise(state, f"{path}/totals{step}")
    return state.drop("up")


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of nodes (conv_id, depth) with members `member`: ascending decimal ids, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            begin = np.concatenate([[0], np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1])
            stop = np.append(begin[1:], batch.num_rows)
            texts = [",".join(map(str, member[a:b].tolist())) for a, b in zip(begin.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(conv[begin]), pa.array(depth[begin]), pa.array(member[begin]), pa.array(texts, pa.string())], names=["conv_id", "depth", "least", "piece"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, depth, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if node == (conv, depth):
                    digest.update(b"," + piece.encode())
                    continue
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256(piece.encode())
            yield _digest_batch(done)
        if node:
            yield _digest_batch([(*node, digest.hexdigest())])

    order = ["conv_id", "depth", "member"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, depth long, least long, piece string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least").mapInArrow(whole, "conv_id long, depth long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(text, pa.string())], names=["conv_id", "depth", "ends_sha256"])


def trie(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    path: where intermediate tables go; by default below the session's shared folder.
    """
    path = path or shared_dir(conversations.sparkSession)
    steps = prefixes(numbered_turns(conversations, path), path)
    minima = steps.groupBy("x1", "x2", "depth").agg(F.min(F.struct("conv_id", "length")).alias("least"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    minima = minima.select("x1", "x2", "depth", F.col("least.conv_id").alias("conv_id"), (F.col("least.length") == F.col("depth")).alias("last"), "n_convs", "bytes")
    nodes = materialise(minima, f"{path}/nodes")
    tops = first_owned(steps, nodes, path)
    # the chain's place: the node above its first owned depth
    above = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("first"), F.col("conv_id").alias("parent"))
    tops = materialise(tops.join(above, ["p1", "p2", "first"], "left").select("conv_id", "first", F.when(F.col("first") > 0, F.col("parent")).alias("parent")), f"{path}/tops")
    # bottom-up: a chain's own values, then all that hangs below it
    hung = tops.where("parent is not null").select(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.col("conv_id").alias("chain"))
    crowned = nodes.join(hung.groupBy("conv_id", "depth").agg(F.count("*").alias("hung")), ["conv_id", "depth"], "left").withColumn("hung", F.coalesce("hung", F.lit(0)))
    crowned = crowned.select("conv_id", "depth", "last", "n_convs", "hung", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("last") & (F.col("hung") == 0)).cast("long").alias("leaves"))
    crowned = materialise(crowned, f"{path}/crowned")
    own = crowned.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    totals = chain_totals(own.join(tops, "conv_id"), path)
    below = hung.join(totals.withColumnRenamed("conv_id", "chain"), "chain").groupBy("conv_id", "depth").agg(F.sum("saved").alias("below_saved"), F.sum("leaves").alias("below_leaves"))
    values = crowned.join(below, ["conv_id", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("below_saved", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("below_leaves", F.lit(0))})
    summed = running(values, "conv_id", F.sum, lambda a, b: a + b, ["saved", "leaves"], back=True)
    # conversations by the node where they end
    last = nodes.select("x1", "x2", "depth", "conv_id")
    ends = steps.where("depth = length").select("x1", "x2", "depth", F.col("conv_id").alias("member")).join(last, ["x1", "x2", "depth"])
    named = summed.join(tops.select("conv_id", F.col("first").alias("depth"), F.lit(True).alias("top"), "parent"), ["conv_id", "depth"], "left").join(end_digests(ends), ["conv_id", "depth"], "left")
    return named.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.when(F.col("top"), F.col("parent")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs",
        (F.col("hung") + F.when(F.col("last"), 0).otherwise(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


#: The same rows in DuckDB. Subtrees are summed over the members of a node; ties of a turn by role and text.
ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
             lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
),
lead AS (SELECT c.conv_id, c.base, c.h, least(c.h, (SELECT count(*) FROM t WHERE t.conv_id = c.base)) AS led FROM c),
r AS (
  SELECT lead.conv_id, t.pos AS depth, t.role, t.text FROM lead JOIN t ON t.conv_id = lead.base AND t.pos <= lead.h
  UNION ALL
  SELECT lead.conv_id, lead.led + t.pos - lead.h, t.role, t.text FROM lead JOIN t ON t.conv_id = lead.conv_id AND t.pos > lead.h
),
p AS (
  SELECT conv_id, depth, strlen(text) AS bytes, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c
),
n AS (
  SELECT *, min(conv_id) OVER (PARTITION BY k) AS owner, count(*) OVER (PARTITION BY k) AS n_convs, max(depth) OVER (PARTITION BY conv_id) AS len FROM p
),
nodes AS (SELECT * FROM n WHERE owner = conv_id),
kids AS (
  SELECT q.owner AS parent, q.depth, count(*) AS n_children FROM nodes JOIN n q ON q.conv_id = nodes.conv_id AND q.depth = nodes.depth - 1 GROUP BY ALL
),
v AS (
  SELECT nodes.conv_id, nodes.depth, (nodes.n_convs - 1) * nodes.bytes AS saved, (kids.n_children IS NULL)::INT AS leaf
  FROM nodes LEFT JOIN kids ON kids.parent = nodes.conv_id AND kids.depth = nodes.depth
),
below AS (
  SELECT n.owner, n.depth, sum(v.saved) AS saved_tokens, sum(v.leaf) AS n_leaves FROM n JOIN v ON v.conv_id = n.conv_id AND v.depth >= n.depth GROUP BY ALL
),
ends AS (SELECT owner, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM n WHERE depth = len GROUP BY ALL)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.owner AS parent_conv_id, nodes.n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children,
       below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes JOIN below ON below.owner = nodes.conv_id AND below.depth = nodes.depth
LEFT JOIN n up ON up.conv_id = nodes.conv_id AND up.depth = nodes.depth - 1
LEFT JOIN kids ON kids.parent = nodes.conv_id AND kids.depth = nodes.depth
LEFT JOIN ends ON ends.owner = nodes.conv_id AND ends.depth = nodes.depth
"""
