"""Prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns; it is known by its depth and its smallest
member. Per depth the live conversations are grouped by (parent node, next turn), and each
group's smallest conversation names the child. A conversation that is alone in its node
isn't live any more: the rest of its turns is a chain of nodes of its own, which needs no
grouping, so there are as many levels as the longest sequence that two conversations share.
Reverse joins, one level at a time, then carry leaves and savings from children to parents.

Turns are known by the first 128 bits of the SHA-256 of role and text, so texts never leave
the scan. Places within a conversation come from ranges, the members of a node are digested
in ordered pieces, and large groups are broadcast where rows look their group up, so one
long conversation, one very common turn or one node with most conversations is no single
task's work (but for the last step of a digest, which reads a stream of pieces).

Rows of one conversation with one turn number follow each other by role, then text digest.
Null role or text is empty. A row without conv_id belongs to no conversation and is left
out. A repeated row is a turn of its own. No conversations give no nodes, not even a root.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow.llm import common as C

#: Members of a piece of a node's digest.
PIECE = 4096
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Turns of conversations that aren't live any more are left out from when the live ones have fallen to this share.
SHRUNK = 0.25

_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), turn (digest), words of every turn, in order of turn (null first)."""
    rows = C.only(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), told.alias("turn"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("at").asc_nulls_first(), "role", "turn"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # repeated rows are dealt out too
    rows = C.written(rows.repartitionByRange("conv_id", *order, "row").withColumn("part", F.spark_partition_id()), "turns")
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order, "row"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a conversation that goes on from one range to the next: at most one for each range
    later = rows.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before is not null").select("part", "conv_id", "before")
    rows = rows.withColumn("inside", inside).join(F.broadcast(later), ["part", "conv_id"], "left")
    return rows.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("depth"), "turn", "words")


def rebuilt(own: DataFrame, base: Column, taken: Column) -> DataFrame:
    """Every conversation begins with the first `taken` turns of conversation `base` (columns of conv_id) instead of its own.

    conv_id, depth, turn, words; and as a second table conv_id, long (turns) of all conversations, turnless ones too.
    """
    heads = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", base.alias("base"), taken.cast("long").alias("h"))
    heads = C.written(heads, "heads")
    others = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = heads.join(others, "base", "left").withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = C.written(plan.select("conv_id", "base", "h", "got", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("long")), "plans")
    most = plan.agg(F.max("h")).first()[0] or 0
    first = own.where(F.col("depth") <= most).withColumnRenamed("conv_id", "base")
    copied = plan.where("got > 0").select("conv_id", "base", "got").join(first, "base").where("depth <= got")
    kept = own.join(plan.select("conv_id", "h", "got"), "conv_id").where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("got"))
    columns = ("conv_id", "depth", "turn", "words")
    return copied.select(*columns).unionByName(kept.select(*columns)), plan.select("conv_id", "long")


_PIECE = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, ids = None, []

    def piece() -> pa.RecordBatch:
        return C.batch_of(_PIECE, node=[now[0]], depth=[now[1]], first=[ids[0]], ids=[",".join(map(str, ids))])

    for b in batches:
        for node, depth, conv in zip(*(b.column(x).to_pylist() for x in ("node", "depth", "conv_id"))):
            if ids and (now != (node, depth) or len(ids) >= PIECE):
                yield piece()
                ids = []
            now = node, depth
            ids.append(conv)
    if ids:
        yield piece()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, None
    for b in batches:
        done: list[tuple] = []
        for node, depth, ids in zip(*(b.column(x).to_pylist() for x in ("node", "depth", "ids"))):
            if now == (node, depth):
                sha.update(b"," + ids.encode())
                continue
            if now:
                done.append((*now, sha.hexdigest()))
            now, sha = (node, depth), hashlib.sha256(ids.encode())
        if done:
            yield C.batch_of(_ENDS, **dict(zip(_ENDS.names, zip(*done))))
    if now:
        yield C.batch_of(_ENDS, node=[now[0]], depth=[now[1]], ends_sha256=[sha.hexdigest()])


def _ends(rows: DataFrame) -> DataFrame:
    """node, depth, ends_sha256 of the nodes that conversations (node, depth, conv_id) end in: ordered pieces, then the pieces of a node one after the other."""
    order = ("node", "depth", "conv_id")
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "node long, depth long, first long, ids string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_digested, "node long, depth long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations with the turns `rows` (conv_id, depth, turn, words) and the lengths `convs` (conv_id, long).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (words of the subtree's turns that a conversation shares with a smaller one), ends_sha256 (of its
    members that end in it).
    """
    spark = rows.sparkSession
    rows = C.written(rows.sortWithinPartitions("depth"), "rebuilt")
    root, total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    one = F.lit(1).cast("long")
    live = C.written(convs.select("conv_id", "long", F.lit(root).alias("node"), F.lit(0).cast("long").alias("depth")), "live")
    shared = [live.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("parent"))]
    lives, children, left, size, held = [live], [], rows, total, total
    while size:  # each level down
        depth = len(lives)
        step = left.where(F.col("depth") == depth).join(live.select("conv_id", "long", "node"), "conv_id")
        found = step.groupBy("node", "turn").agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words"), F.min("long").alias("long"))
        groups = C.written(found, "groups")
        children.append(groups)
        many = groups.where("n > 1")
        size = many.agg(F.sum("n")).first()[0] or 0
        if not size:
            break
        shared.append(many.select(F.col("child").alias("node"), "n", "words", F.col("node").alias("parent")))
        named = C.with_groups(step.drop("depth", "words"), many.select("node", "turn", "child", "n"), ["node", "turn"], "n", total)
        live = C.written(named.select("conv_id", "long", F.col("child").alias("node"), F.lit(depth).cast("long").alias("depth")), "live")
        lives.append(live)
        if size <= SHRUNK * held:
            left, held = C.written(left.where(F.col("depth") > depth).join(live.select("conv_id"), "conv_id", "left_semi"), "left"), size
    below, levels = None, []
    for depth in range(len(shared) - 1, -1, -1):  # and up again
        node = shared[depth].withColumn("saved", (F.col("n") - 1) * F.col("words"))
        if depth < len(children):
            lone = children[depth].where("n = 1").select("node", one.alias("leaves"), F.lit(0).cast("long").alias("saved"))
            kids = lone if below is None else lone.unionByName(below.select(F.col("parent").alias("node"), "leaves", "saved"))
            kids = kids.groupBy("node").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("under"), F.sum("saved").alias("more"))
            node = node.join(kids, "node", "left")
        else:
            node = node.withColumns({x: F.lit(None).cast("long") for x in ("n_children", "under", "more")})
        node = node.select("node", F.lit(depth).cast("long").alias("depth"), "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("under", one).alias("leaves"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"))
        below = C.written(node, "level")
        levels.append(below)
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    ends = _ends(union(lives).where(F.col("long") == F.col("depth")).select("node", "depth", "conv_id"))
    upper = union(levels).join(ends, ["node", "depth"], "left")
    upper = upper.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    alone = [t.where("n = 1").select(F.col("child").alias("conv_id"), F.col("node").alias("above"), F.lit(k).cast("long").alias("since"), "long") for k, t in enumerate(children, 1)]
    chains = rows.select("conv_id", "depth").join(union(alone), "conv_id").where("depth >= since")
    last = F.col("depth") == F.col("long")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("since"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_EMPTY).alias("ends_sha256"),
    )
    return upper.unionByName(chains)


def opening(conv: Column) -> tuple[Column, Column]:
    """The query's own rebuilding: (base conversation, turns taken from it)."""
    return conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns(C.read(spark, sf_dir, "conversations")), *opening(F.col("conv_id"))))


ORACLE = r"""
WITH RECURSIVE bits(b, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, any_value(t) AS t FROM o, crc GROUP BY conv_id),
h AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h FROM c),
g AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS got FROM h LEFT JOIN h b ON b.conv_id = h.base),
r AS (SELECT g.conv_id, o.i AS depth, o.role, o.body FROM g JOIN o ON o.conv_id = g.base AND o.i <= g.got
  UNION ALL SELECT g.conv_id, o.i - g.h + g.got, o.role, o.body FROM g JOIN o ON o.conv_id = g.conv_id AND o.i > g.h),
p AS (SELECT conv_id, depth, sha256(string_agg(sha256(length(role) || ':' || role || body), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
m AS (SELECT *, lead(depth) OVER w AS later, min(conv_id) OVER k AS first, count(*) OVER k AS n FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth), k AS (PARTITION BY depth, key)),
u AS (SELECT *, lag(first) OVER w AS above, sum(CASE WHEN first = conv_id THEN (n - 1) * words ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS saved,
  max(CASE WHEN later IS NULL THEN key END) OVER (PARTITION BY conv_id) AS last_key, max(depth) OVER (PARTITION BY conv_id) AS last_depth FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
leaf AS (SELECT depth, key FROM m GROUP BY depth, key HAVING max(later) IS NULL),
v AS (SELECT u.*, leaf.key IS NOT NULL AS at_leaf FROM u LEFT JOIN leaf ON leaf.depth = u.last_depth AND leaf.key = u.last_key),
kids AS (SELECT depth - 1 AS depth, above, count(DISTINCT key) AS n_children FROM u WHERE depth > 0 GROUP BY 1, 2),
a AS (SELECT first AS conv_id, depth::BIGINT AS depth, any_value(above) AS parent_conv_id, count(*) AS n_convs, count(DISTINCT CASE WHEN at_leaf THEN last_depth || ':' || last_key END) AS n_leaves,
  sum(saved)::BIGINT AS saved_tokens, sha256(coalesce(string_agg(CASE WHEN later IS NULL THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM v GROUP BY first, depth)
SELECT a.conv_id, a.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256 FROM a LEFT JOIN kids ON kids.depth = a.depth AND kids.above = a.conv_id
"""
