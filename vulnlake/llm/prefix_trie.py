"""The trie of shared conversation beginnings, measured by the Euler-tour technique.

Every distinct sequence of first turns is a node.  Each node gives an enter and an exit arc; the arcs' successors
(first child, next sibling, parent) form one list.  The list is ranked distributedly: in each round an independent set
of arcs (those whose random priority is above both neighbours') is spliced out, a third of all, until ``FINISH`` are
left; their ranks are found by one walk and handed back round by round, so all rounds together cost a few passes.
Ranks are positions on the tour; running sums of leaves and savings over the positions, taken at a node's exit and
enter arcs, differ by what its subtree holds.

A node is known by 128 bits: the exclusive or, over its turns, of hashes of (depth, role, text).  Conversations and
nodes are ordered by range sorts; no window, list or task ever holds a conversation, a node's members or a node's
children whole.  A digest over the ids that end at a node is a serial function of them, so they reach it in order, as a
stream of joined pieces.

Null roles and texts are empty.  Turns with the same number are ordered by role, then by text (their first characters,
then a hash), so repeated rows are turns of their own.  Rows without conv_id belong to no conversation and are passed
over.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.sorted_runs import SLICE, running, sorted_parts, previous
from vulnlake.session import cut_lineage

FINISH = 1 << 13
PIECE = 4096


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first one of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def group_start(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x1, x2, bytes): the turns in order, from 1, as 128 bits and the text's size."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.substring(role, 1, 16).alias("_role"), F.substring(text, 1, 32).alias("_text"),
        F.xxhash64(F.lit(1), role, text).alias("x1"), F.xxhash64(F.lit(2), role, text).alias("x2"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("_one"),
    )
    parts = sorted_parts(narrow, ["conv_id", F.asc_nulls_first("turn"), "_role", "_text", "x1", "x2"])
    return running(parts.drop("turn", "_role", "_text"), "conv_id", {"pos": ("_one", "sum")}).drop("_one", SLICE)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with taken-over beginnings: (conv_id, depth, z1, z2, bytes, length) and (conv_id, length)."""
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", group_start(c).alias("start"), shared_turns(c).alias("h"))
    starts = convs.filter("conv_id = start").select("start", F.col("n").alias("n_start"))
    taken = F.least("h", F.coalesce("n_start", F.lit(0)))
    convs = convs.join(starts, "start", "left").withColumn("m", taken)
    convs = cut_lineage(convs.select("conv_id", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(convs, "conv_id").filter("pos > h").withColumn("depth", F.col("m") + F.col("pos") - F.col("h"))
    first = F.when(c > 0, c).otherwise(c - 4)
    last = F.when(c < 0, c).otherwise(c + 4)
    begun = turns.filter((c % 5 == 0) & (F.col("pos") <= 8)).withColumn("conv_id", F.explode(F.sequence(first, last)))
    begun = begun.join(convs, "conv_id").filter("pos <= h").withColumn("depth", F.col("pos"))
    columns = ["conv_id", "depth", "x1", "x2", "bytes", "length"]
    rows = own.select(*columns).unionByName(begun.select(*columns))
    hashed = [F.xxhash64(F.lit(i), "depth", "x1", "x2").alias(f"z{i}") for i in (1, 2)]
    return rows.select("conv_id", "depth", *hashed, "bytes", "length"), convs.select("conv_id", "length")


def trie_nodes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, p1, p2, q1, q2, conv_id, n_convs, bytes), q of the parent, and where conversations end."""
    parts = sorted_parts(rows, ["conv_id", "depth"])
    paths = running(parts, "conv_id", {"p1": ("z1", "xor"), "p2": ("z2", "xor")})
    before = [F.first(F.col(f"p{i}").bitwiseXOR(F.col(f"z{i}"))).alias(f"q{i}") for i in (1, 2)]
    nodes = paths.groupBy("depth", "p1", "p2").agg(
        *before, F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        *[zero.alias(n) for n in ("depth", "p1", "p2")], *[F.lit(None).cast("long").alias(n) for n in ("q1", "q2")],
        "conv_id", "n_convs", zero.alias("bytes"),
    )
    ends = paths.filter("depth = length").select("depth", "p1", "p2", "conv_id").unionByName(
        convs.filter("length = 0").select(*[zero.alias(n) for n in ("depth", "p1", "p2")], "conv_id")
    )
    return nodes.unionByName(root), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes at which conversations end, ids ascending."""
    key = ["depth", "p1", "p2"]

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(4)]
            changes = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            begins = np.flatnonzero(np.concatenate([[True], changes]))
            begins = np.unique(np.concatenate([begins, np.arange(0, batch.num_rows, PIECE)]))
            ids = [str(i) for i in columns[3].tolist()]
            ended = [*begins[1:].tolist(), len(ids)]
            texts = [",".join(ids[a:b]) for a, b in zip(begins.tolist(), ended, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[begins]) for c in columns] + [pa.array(texts, pa.string())], [*key, "conv_id", "ids"])

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*key, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, digest.hexdigest())], [*key, "ends_sha256"])

    pieces = ends.select(*key, "conv_id").orderBy(*key, "conv_id").mapInArrow(joined, "depth long, p1 long, p2 long, conv_id long, ids string")
    in_order = pieces.repartition(*key).sortWithinPartitions(*key, "conv_id")
    return in_order.mapInArrow(digested, "depth long, p1 long, p2 long, ends_sha256 string")


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with dense numbers: id, parent, parent_conv_id, first_child, n_children, sibling (the next one's id)."""
    key = F.lit(0).cast("long")
    parts = sorted_parts(nodes.withColumns({"_one": F.lit(1).cast("long"), "_all": key}), ["conv_id", "depth"])
    ids = cut_lineage(running(parts, "_all", {"id": ("_one", "sum")}).drop("_one", "_all", SLICE))
    up = ids.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    children = ids.filter("depth > 0").join(up, ["depth", "q1", "q2"]).select("id", "conv_id", "parent", "parent_conv_id")
    beside = previous(sorted_parts(children, ["parent", F.desc("conv_id")]), "parent", "id", "sibling").drop(SLICE, "conv_id")
    down = children.groupBy(F.col("parent").alias("id")).agg(F.min_by("id", "conv_id").alias("first_child"), F.count(F.lit(1)).alias("n_children"))
    return cut_lineage(ids.join(beside, "id", "left").join(down, "id", "left").na.fill(0, ["n_children"]))


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs' list (arc, prev, nxt): a node's enter arc is twice its number, the exit arc one more."""
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    after_enter = F.coalesce(F.col("first_child") * 2, leave)
    after_exit = F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1)
    nxt = nodes.select(F.explode(F.array(F.struct(enter.alias("arc"), after_enter.alias("nxt")), F.struct(leave.alias("arc"), after_exit.alias("nxt")))).alias("a")).select("a.*")
    both = nxt.select("arc", F.lit(None).cast("long").alias("prev"), "nxt").unionByName(
        nxt.filter("nxt IS NOT NULL").select(F.col("nxt").alias("arc"), F.col("arc").alias("prev"), F.lit(None).cast("long").alias("nxt")))
    return both.groupBy("arc").agg(F.max("prev").alias("prev"), F.max("nxt").alias("nxt"))


def list_ranks(arcs: DataFrame, finish: int = FINISH) -> DataFrame:
    """(arc, rank): how many arcs of the list (arc, prev, nxt) stand before each."""
    spark = arcs.sparkSession
    one = F.lit(1).cast("long")
    now = cut_lineage(arcs.select("arc", "prev", one.alias("back"), "nxt", one.alias("on")))
    rounds: list[DataFrame] = []
    none = F.lit(None).cast("long")
    while now.count() > finish:
        high = [F.xxhash64(F.lit(len(rounds)), c) for c in ("arc", "prev", "nxt")]
        leaves = F.coalesce((high[0] > high[1]) & (high[0] > high[2]) & F.col("prev").isNotNull() & F.col("nxt").isNotNull(), F.lit(False))
        out, rest = now.filter(leaves), now.filter(~leaves)
        messages = rest.select("arc", "prev", "back", "nxt", "on", none.alias("new_prev"), none.alias("new_nxt")).unionByName(
            out.select(F.col("prev").alias("arc"), none.alias("prev"), F.lit(0).cast("long").alias("back"), none.alias("nxt"), "on", none.alias("new_prev"), F.col("nxt").alias("new_nxt"))
        ).unionByName(
            out.select(F.col("nxt").alias("arc"), none.alias("prev"), "back", none.alias("nxt"), F.lit(0).cast("long").alias("on"), F.col("prev").alias("new_prev"), none.alias("new_nxt"))
        )
        rounds.append(out.select("arc", "prev", "back"))
        now = cut_lineage(messages.groupBy("arc").agg(
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"), F.sum("back").alias("back"),
            F.coalesce(F.max("new_nxt"), F.max("nxt")).alias("nxt"), F.sum("on").alias("on"),
        ))
    few = {r.arc: r for r in now.collect()}  # at most ``finish`` arcs
    at, rank, found = next((r.arc for r in few.values() if r.prev is None), None), 0, []
    while at is not None:
        found.append((at, rank))
        at, rank = few[at].nxt, rank + few[at].on
    ranks = spark.createDataFrame(found, "arc long, rank long")
    for out in reversed(rounds):
        known = ranks.select(F.col("arc").alias("prev"), F.col("rank").alias("_rank"))
        ranks = cut_lineage(ranks.unionByName(out.join(known, "prev").select("arc", (F.col("_rank") + F.col("back")).alias("rank"))))
    return ranks


def subtree_sums(nodes: DataFrame, finish: int = FINISH) -> DataFrame:
    """(id, n_leaves, saved_tokens) of every node's subtree, from running sums along the tour."""
    leaf = (F.col("n_children") == 0).cast("long")
    saving = (F.col("n_convs") - 1) * F.col("bytes")
    weights = nodes.select("id", leaf.alias("leaf"), saving.alias("saving"))
    ranks = list_ranks(tour(nodes), finish).select(F.shiftright("arc", 1).alias("id"), (F.col("arc") % 2 == 0).alias("enters"), "rank")
    zero = F.lit(0).cast("long")
    steps = ranks.join(weights, "id").select(
        "id", "rank", F.when(F.col("enters"), F.col("leaf")).otherwise(zero).alias("leaf"),
        F.when(F.col("enters"), F.col("saving")).otherwise(zero).alias("saving"), zero.alias("_all"),
    )
    sums = running(sorted_parts(steps, ["rank"]), "_all", {"leaves": ("leaf", "sum"), "saved": ("saving", "sum")})
    return sums.groupBy("id").agg(  # own weights stand at the enter arc, which the difference leaves out
        (F.max("leaves") - F.min("leaves") + F.sum("leaf")).alias("n_leaves"),
        (F.max("saved") - F.min("saved") + F.sum("saving")).alias("saved_tokens"),
    )


def prefix_trie(conversations: DataFrame, finish: int = FINISH) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    rows, convs = rebuilt(cut_lineage(numbered_turns(conversations)))
    nodes, ends = trie_nodes(rows, convs)
    nodes = linked_nodes(nodes)
    out = nodes.join(subtree_sums(nodes, finish), "id").join(end_digests(ends), ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def sql() -> str:
    return """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, k, r) AS (
  SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(r, ascii(s[k // 8 + 1])::BIGINT) ELSE r END AS v FROM crc WHERE k < 8 * len(s))),
convs AS (
  SELECT c, c - c % 5 AS b, xor(r, 4294967295::BIGINT) % 9 AS h FROM crc WHERE k = 8 * len(s)),
base AS (
  SELECT c, b, h, (SELECT count(*) FROM turns t WHERE t.conv_id = b) AS n FROM convs),
rebuilt AS (
  SELECT c, pos AS d, role, text FROM base JOIN turns ON conv_id = b AND pos <= h
  UNION ALL
  SELECT c, least(h, n) + pos - h, role, text FROM base JOIN turns ON conv_id = c AND pos > h),
paths AS (
  SELECT c, d, text, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, '', [] FROM convs),
named AS (
  SELECT c, d, text, min(c) OVER w AS rep, count(*) OVER w AS n, max(d) OVER (PARTITION BY c) AS length
  FROM paths WINDOW w AS (PARTITION BY d, path)),
nodes AS (
  SELECT rep, d, any_value(n) AS n_convs, any_value((n - 1) * strlen(text)) AS saving,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = length), '')) AS ends_sha256
  FROM named GROUP BY rep, d),
edges AS (
  SELECT v.rep, v.d, p.rep AS parent FROM nodes v JOIN named p ON p.c = v.rep AND p.d = v.d - 1),
children AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM edges GROUP BY parent, d - 1),
sums AS (
  SELECT a.rep, a.d, sum(v.saving)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes v JOIN named a ON a.c = v.rep AND a.d <= v.d LEFT JOIN children k ON k.rep = v.rep AND k.d = v.d
  GROUP BY a.rep, a.d)
SELECT v.rep AS conv_id, v.d::BIGINT AS depth, e.parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, ends_sha256
FROM nodes v JOIN sums s ON s.rep = v.rep AND s.d = v.d
LEFT JOIN edges e ON e.rep = v.rep AND e.d = v.d LEFT JOIN children k ON k.rep = v.rep AND k.d = v.d
"""
