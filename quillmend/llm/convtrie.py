"""A z-fast trie of conversations: the prefixes that they share, and what sharing them saves.

A conversation is a string of turns. A prefix has a digest, the XOR of hashes of (place, turn), so digests of all
prefixes are running aggregates and never need a conversation as one value. Nodes of the compacted trie lie on
segments: a segment is the part of one conversation that it added to the trie, and its points are where other
conversations branch off or end. Every node is filed under its handle, the prefix whose length is the two-fattest
number on its edge, and under its name, the prefix one turn below its parent. A conversation finds its exit node
by fat binary search: it asks for the prefix at the two-fattest length between what is known to be in the trie
and what may be, so log2(length) joins do. Conversations are inserted in batches: of all that leave the trie
at one place by one turn, one drawn by hash goes in, the rest look again below it; those that part
later do so after as many batches as they have branchings in which they were in the smaller part. Last, edges
are expanded to a node for every depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .mixing import word_count

#: Turns of a conversation whose running digests one window takes at once.
STRETCH = 1024
#: So many ids of conversations that end at a node are put in one row for hashing.
ENDS_PER_ROW = 4096


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos (1, 2, ... by turn, nulls first; ties by a hash of role and text), key (MD5 of role and text), words.

    Null roles and texts count as empty. Rows with a null ``conv`` belong to no conversation.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t))
    slim = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), key.alias("key"), word_count(text).alias("words"))
    ordered = common.placed(slim, "conv", "turn", "key")
    first = ordered.groupBy("conv").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    return ordered.join(first, "conv").select("conv", (F.col("place") - F.col("first") + 1).alias("pos"), "n", "key", "words")


def running(rows: DataFrame) -> DataFrame:
    """conv, depth, d1, d2 (digest of the prefix), words, cum (words of the prefix), for rows (conv, depth, key, words).

    Long conversations are taken in stretches that know what came before them.
    """
    rows = rows.withColumns({"d1": F.xxhash64("depth", "key"), "d2": F.xxhash64("key", "depth"), "stretch": F.expr(f"depth div {STRETCH}")})
    w = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("conv", "depth", "stretch", "words", F.bit_xor("d1").over(w).alias("d1"), F.bit_xor("d2").over(w).alias("d2"), F.sum("words").over(w).alias("cum"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.filter(f"depth >= {STRETCH}").select("conv").distinct()
    whole = rows.join(long, "conv", "left_semi").groupBy("conv", "stretch").agg(F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"), F.sum("words").alias("sum"))
    carry = whole.select("conv", "stretch", F.bit_xor("x1").over(before).alias("x1"), F.bit_xor("x2").over(before).alias("x2"), F.sum("sum").over(before).alias("sum")).filter("stretch > 0")
    out = inside.join(carry, ["conv", "stretch"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select("conv", "depth", F.col("d1").bitwiseXOR(F.coalesce("x1", zero)).alias("d1"), F.col("d2").bitwiseXOR(F.coalesce("x2", zero)).alias("d2"), "words", (F.col("cum") + F.coalesce("sum", zero)).alias("cum"))


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the greatest power of two divides."""
    m = F.length(F.bin(low.bitwiseXOR(high))) - 1  # the highest bit in which they differ
    return F.call_function("shiftleft", F.call_function("shiftright", high, m), m)


class Trie:
    """``prefixes``: conv, depth, d1, d2, words, cum; ``convs``: conv, len; ``points``: rep, attach, depth.

    A point is a node: the prefix of conversation ``rep`` of this depth. ``attach``: the depth at which the
    segment of ``rep`` leaves the rest of the trie.
    """

    def __init__(self, prefixes: DataFrame, convs: DataFrame):
        self.prefixes, self.convs = prefixes, convs
        self.points: DataFrame | None = None
        self.tables: DataFrame | None = None
        self.longest = convs.agg(F.max("len")).first()[0] or 0

    def _digests(self, df: DataFrame, conv: str, depth: Column, name: str) -> DataFrame:
        """``df`` with name1 and name2, the digest of that prefix (null where there is none)."""
        p = self.prefixes.select(F.col("conv").alias("__conv"), F.col("depth").alias("__depth"), F.col("d1").alias(name + "1"), F.col("d2").alias(name + "2"))
        return df.withColumn("__at", depth).join(p, (F.col(conv) == F.col("__conv")) & (F.col("__at") == F.col("__depth")), "left").drop("__conv", "__depth", "__at")

    def nodes(self) -> DataFrame:
        """The points with ``pdepth``, their parent's depth."""
        w = Window.partitionBy("rep").orderBy("depth")
        return self.points.withColumn("pdepth", F.coalesce(F.lag("depth").over(w), "attach"))

    def _file(self) -> None:
        """Files every node under its handle (kind 0) and its name (kind 1)."""
        keys = F.explode(F.array(F.struct(F.lit(0).alias("kind"), fattest(F.col("pdepth"), F.col("depth")).alias("at")), F.struct(F.lit(1).alias("kind"), (F.col("pdepth") + 1).alias("at"))))
        filed = self.nodes().withColumn("k", keys).select("rep", "attach", "depth", "pdepth", "k.kind", "k.at")
        self.tables = common.staged(self._digests(filed, "rep", F.col("at"), "k"), "filed")

    def _asked(self, df: DataFrame, kind: int, at: str) -> DataFrame:
        """``df`` (with k1, k2) with the node filed under that prefix, in a struct ``hit``."""
        t = self.tables.filter(F.col("kind") == kind).select(F.col("at").alias("__at"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.struct("rep", "attach", "depth", "pdepth", "at").alias("hit"))
        return df.join(t, (F.col(at) == F.col("__at")) & (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left").drop("__at", "__k1", "__k2", "k1", "k2")

    def located(self, active: DataFrame) -> DataFrame:
        """For each conversation (conv, len) its exit: the edge (rep, attach, edge: its depth; null at the root without a child) and ``lcp``, how much of it is in the trie."""
        none = F.lit(None).cast("struct<rep:bigint,attach:bigint,depth:bigint,pdepth:bigint,at:bigint>")
        q = active.withColumns({"low": F.lit(0).cast("bigint"), "high": F.col("len"), "node": none})
        if self.tables is None:
            return q.select("conv", "len", F.col("node.rep").alias("rep"), F.col("node.attach").alias("attach"), F.col("node.depth").alias("edge"), F.col("low").alias("lcp"))
        for _ in range(self.longest.bit_length() + 1):
            q = q.withColumn("f", F.when(F.col("low") < F.col("high"), fattest(F.col("low"), F.col("high"))).otherwise(F.lit(-1).cast("bigint")))
            q = self._asked(self._digests(q, "conv", F.col("f"), "k"), 0, "f")
            found = F.col("hit").isNotNull()
            q = q.withColumns({"high": F.when(found | (F.col("f") < 0), F.col("high")).otherwise(F.col("f") - 1), "low": F.when(found, F.col("hit.depth")).otherwise(F.col("low")), "node": F.coalesce("hit", "node")}).drop("hit", "f")
        # the exit is that node's edge, or a child's, if the first turn below the node is there
        below = F.coalesce(F.col("node.depth"), F.lit(0))
        q = q.withColumn("f", F.when(F.col("len") > below, below + 1).otherwise(F.lit(-1)))
        q = self._asked(self._digests(q, "conv", F.col("f"), "k"), 1, "f").withColumn("node", F.coalesce("hit", "node"))
        q = q.select("conv", "len", F.col("node.rep").alias("rep"), F.col("node.attach").alias("attach"), F.col("node.depth").alias("edge"), F.coalesce("node.at", F.lit(0)).alias("low"), F.least("len", F.coalesce("node.depth", F.lit(0))).alias("high"))
        q = common.staged(q, "exits")
        # how far the edge is shared, turn by turn
        mine = self.prefixes.select(F.col("conv").alias("__conv"), "depth", "d1", "d2")
        theirs = self.prefixes.select(F.col("conv").alias("rep"), "depth", "d1", "d2")
        steps = q.filter("low < high").join(mine, (F.col("conv") == F.col("__conv")) & (F.col("depth") > F.col("low")) & (F.col("depth") <= F.col("high")))
        shared = steps.join(theirs, ["rep", "depth", "d1", "d2"]).groupBy("conv").agg(F.max("depth").alias("shared"))
        return q.join(shared, "conv", "left").select("conv", "len", "rep", "attach", "edge", F.coalesce("shared", "low").alias("lcp"))

    def insert(self) -> None:
        """Inserts all conversations that have a turn, batch after batch."""
        active = self.convs.filter("len > 0")
        while not active.isEmpty():
            found = common.staged(self.located(active), "located")
            leaving = self._digests(found.filter("lcp < len"), "conv", F.col("lcp") + 1, "k")
            chosen = leaving.groupBy("lcp", "k1", "k2").agg(F.min_by(F.struct("conv", "len"), F.struct(F.xxhash64("conv"), "conv")).alias("c"))
            chosen = common.staged(chosen.select("c.conv", "c.len", "lcp"), "chosen")
            split = found.filter("lcp < edge").select("rep", "attach", F.col("lcp").alias("depth")).distinct()
            new = chosen.select(F.col("conv").alias("rep"), F.col("lcp").alias("attach"), F.col("len").alias("depth")).unionByName(split)
            self.points = common.staged(new if self.points is None else self.points.unionByName(new), "points")
            self._file()
            active = common.staged(found.filter("lcp < len").join(chosen.select("conv"), "conv", "left_anti").select("conv", "len"), "active")


def _ids_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; rows (rep, depth, ids) of a node one after the other."""
    last, state = None, None
    for batch in batches:
        out = []
        for rep, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (rep, depth) == last:
                state.update(b",")
            else:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (rep, depth), hashlib.sha256()
            state.update(ids.encode())
        yield _rows(out)
    if last is not None:
        yield _rows([(*last, state.hexdigest())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["rep", "depth", "ends"])


def ends(ended: DataFrame) -> DataFrame:
    """rep, depth, ends: SHA-256 of the comma-joined ids (``conv``, ascending) of each node.

    A node's ids are hashed one after the other, as SHA-256 wants it, but as rows of thousands of ids that
    other tasks have put together, and no more than one of these is held.
    """
    listed = common.placed(ended.select("rep", "depth", "conv"), "rep", "depth", "conv").withColumn("row", F.expr(f"place div {ENDS_PER_ROW}"))
    joined = listed.groupBy("rep", "depth", "row").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return joined.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "row").select("rep", "depth", "ids").mapInArrow(_ids_hashed, "rep bigint, depth bigint, ends string")


NO_ENDS = hashlib.sha256(b"").hexdigest()


def summary(trie: Trie) -> DataFrame:
    """A row for every prefix: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    What a node's subtree saves is, over its members, the words from the node on, less those of the distinct
    nodes there; of these every one belongs to its least member. So sums over members do, of which the pairs
    (conversation, node of the compacted trie on its path) are as many as turns at most.
    """
    p, convs = trie.prefixes, trie.convs
    root = convs.groupBy().agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("total").alias("s1")).first()  # one row
    if not root.n:
        return trie.convs.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    spark = convs.sparkSession
    if trie.points is None:  # no conversation has a turn
        trie.points = spark.createDataFrame([], "rep bigint, attach bigint, depth bigint")
    nodes = trie._digests(trie.nodes(), "rep", F.col("depth"), "d")
    nodes = common.staged(trie._digests(nodes, "rep", F.col("pdepth"), "p"), "nodes")
    onpath = p.select("conv", "depth", "d1", "d2").join(nodes.select("rep", "depth", "pdepth", "d1", "d2"), ["depth", "d1", "d2"])
    pairs = common.staged(onpath.select("conv", "rep", "depth", "pdepth"), "pairs")
    total = convs.select("conv", "len", "total")
    sums = pairs.join(total, "conv").groupBy("rep", "depth").agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("total").alias("s1"), F.first("pdepth").alias("pdepth"))
    sums = common.staged(sums, "sums")
    # a conversation owns the nodes of which it is the least member: its path from some depth on
    owned = sums.groupBy(F.col("least").alias("conv")).agg(F.min("pdepth").alias("from"))
    before = p.select(F.col("conv"), F.col("depth").alias("from"), F.col("cum").alias("before"))
    children = nodes.groupBy("p1", "p2", F.col("pdepth").alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    leaf = sums.join(nodes.select("rep", "depth", "d1", "d2"), ["rep", "depth"]).join(children, (F.col("d1") == F.col("p1")) & (F.col("d2") == F.col("p2")), "left_anti").select(F.col("least").alias("conv"), F.lit(1).alias("leaf"))
    own = total.join(owned, "conv", "left").join(before, ["conv", "from"], "left").join(leaf, "conv", "left")
    own = own.select("conv", "total", F.when(F.col("from").isNull(), 0).otherwise(F.col("total") - F.coalesce("before", F.lit(0))).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    own = common.staged(own, "owned")
    more = pairs.join(own, "conv").groupBy("rep", "depth").agg(F.sum("owned").alias("s2"), F.sum("leaf").alias("n_leaves"))
    least = own.select(F.col("conv").alias("least"), (F.col("total") - F.col("owned")).alias("extra"))
    ended = pairs.join(total, "conv").filter("depth = len").select("rep", "depth", "conv").unionByName(convs.filter("len = 0").select(F.lit(0).cast("bigint").alias("rep"), F.lit(0).cast("bigint").alias("depth"), "conv"))
    hashed = common.staged(ends(ended), "ends")
    full = nodes.join(sums.drop("pdepth"), ["rep", "depth"]).join(more, ["rep", "depth"]).join(least, "least")
    kids = children.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("n_children").alias("branches"))
    full = full.join(kids, ["d1", "d2"], "left").join(hashed, ["rep", "depth"], "left").withColumn("k", F.col("s2") + F.col("extra"))
    above = nodes.join(sums.select("rep", "depth", "least"), ["rep", "depth"]).select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("least").alias("above"))
    full = full.join(above, ["p1", "p2"], "left").withColumn("above", F.coalesce("above", F.lit(root.least)))
    full = full.select("rep", F.col("depth").alias("bottom"), "pdepth", "least", "n", "s1", "k", "n_leaves", F.coalesce("branches", F.lit(0)).alias("branches"), "ends", "above")
    # edges to nodes, a stretch of an edge at a time
    first, last = F.col("pdepth") + 1, F.col("bottom")
    stretches = full.withColumn("stretch", F.explode(F.sequence(F.expr(f"(pdepth + 1) div {STRETCH}"), F.expr(f"bottom div {STRETCH}"))))
    depths = stretches.withColumn("depth", F.explode(F.sequence(F.greatest(first, F.col("stretch") * STRETCH), F.least(last, F.col("stretch") * STRETCH + STRETCH - 1))))
    at = depths.join(p.select(F.col("conv").alias("rep"), "depth", (F.col("cum") - F.col("words")).alias("before")), ["rep", "depth"])
    inner = F.col("depth") < last
    out = at.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > first, F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inner, F.lit(1).cast("bigint")).otherwise(F.col("branches")).alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"),
        (F.col("s1") - F.col("k") - (F.col("n") - 1) * F.col("before")).cast("bigint").alias("saved_tokens"), F.when(inner, F.lit(NO_ENDS)).otherwise(F.coalesce("ends", F.lit(NO_ENDS))).alias("ends_sha256"),
    )
    top = own.groupBy().agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaves"))
    branches = nodes.filter("pdepth = 0").groupBy().agg(F.count(F.lit(1)).alias("branches"))
    there = hashed.filter("depth = 0").groupBy().agg(F.max("ends").alias("ends"))
    r = top.join(branches, F.lit(True)).join(there, F.lit(True))  # three single rows
    whole = r.select(
        F.lit(root.least).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(root.n).cast("bigint").alias("n_convs"), F.col("branches").alias("n_children"),
        F.greatest(F.col("leaves"), F.lit(1)).cast("bigint").alias("n_leaves"), (F.lit(root.s1) - F.col("owned")).cast("bigint").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return out.unionByName(whole)


def build(rows: DataFrame, ids: DataFrame | None = None) -> Trie:
    """The trie of conversations given as rows (conv, depth 1, 2, ..., key, words); ids (conv): those without rows, too."""
    prefixes = common.staged(running(rows), "prefixes")
    sizes = prefixes.groupBy("conv").agg(F.max("depth").alias("len"), F.max("cum").alias("total"))
    if ids is not None:
        sizes = ids.join(sizes, "conv", "left").select("conv", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("total", F.lit(0)).alias("total"))
    trie = Trie(prefixes, common.staged(sizes, "conversations"))
    trie.insert()
    return trie


#: The rebuilding of the query: conversations in groups of ``GROUP`` ids share the first turns of the group's least id, fewer than ``MOST_SHARED``.
GROUP, MOST_SHARED = 20, 4


def rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (from :func:`turns`) whose first turns are replaced by those of the group's first; and all ids."""
    t = common.staged(t, "turns")
    convs = t.groupBy("conv").agg(F.first("n").alias("n")).withColumns({"h": F.crc32(F.col("conv").cast("string")) % MOST_SHARED, "donor": F.col("conv") - F.col("conv") % GROUP})
    donors = convs.select(F.col("conv").alias("donor"), F.col("n").alias("n_donor"))
    convs = common.staged(convs.join(donors, "donor", "left").withColumn("m", F.least("h", F.coalesce("n_donor", F.lit(0)))), "rebuilt")
    own = t.join(convs.select("conv", "h", "m"), "conv").filter("pos > h").select("conv", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "key", "words")
    heads = t.filter(F.col("pos") < MOST_SHARED).select(F.col("conv").alias("donor"), F.col("pos").alias("depth"), "key", "words")
    given = convs.filter("m > 0").select("conv", "donor", "h").join(heads, "donor").filter("depth <= h").select("conv", "depth", "key", "words")
    return own.unionByName(given), convs.select("conv")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations. Without conversations there is no root either."""
    t = turns(common.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return summary(build(*rebuilt(t)))


ORACLE = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT c, max(pos) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h
  FROM t GROUP BY c
), g AS (
  SELECT n.c AS c, n.c - n.c % 20 AS donor, n.h AS h, least(n.h, coalesce(o.n, 0)) AS m FROM n LEFT JOIN n AS o ON o.c = n.c - n.c % 20
), r AS (
  SELECT c, m + pos - h AS depth, role, text FROM t JOIN g USING (c) WHERE pos > h
  UNION ALL SELECT g.c, t.pos, t.role, t.text FROM g JOIN t ON t.c = g.donor AND t.pos <= g.h
), p AS (
  SELECT c, depth, text, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY depth) AS prefix FROM r
  UNION ALL SELECT c, 0, '', [] FROM g
), node AS (
  SELECT prefix, depth, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS saved FROM p GROUP BY prefix, depth
), ended AS (
  SELECT prefix, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM p JOIN (SELECT c, max(depth) AS depth FROM p GROUP BY c) USING (c, depth) GROUP BY prefix
), child AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1
), up AS (
  SELECT u.prefix[1:d] AS prefix, sum(u.saved) AS saved, count(*) FILTER (child.k IS NULL) AS leaves
  FROM (SELECT node.*, unnest(range(depth + 1)) AS d FROM node) AS u LEFT JOIN child ON child.prefix = u.prefix GROUP BY 1
)
SELECT node.conv_id AS conv_id, CAST(node.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, n AS n_convs, coalesce(child.k, 0) AS n_children,
       up.leaves AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ended.ids, '')) AS ends_sha256
FROM node JOIN up ON up.prefix = node.prefix LEFT JOIN child ON child.prefix = node.prefix LEFT JOIN ended ON ended.prefix = node.prefix
LEFT JOIN (SELECT prefix, conv_id FROM node) AS above ON node.depth > 0 AND above.prefix = node.prefix[1:node.depth - 1]
"""
