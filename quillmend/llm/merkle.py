"""A Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent in it.

Every record is a leaf, the SHA-256 of its fields. Leaves of a group, in order, are hashed in runs of
``RUN``, the results again, until one node remains; those of all groups are put together likewise, to the
root. What is stored is content-addressed: for the digest of each inner node the list of its children. A
proof is fetched by descent from the root: the digits (base ``RUN``) of a group's number and of a leaf's rank
choose a child at each level, the children not chosen are collected, and the collected segments, reversed,
fold a leaf into the root. Leaves of one run share all digits but the last, so one request goes down for
the run, and each leaf takes its own child at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUN = 16
#: A level of the DAG with at most this many records (of some ``RUN * 64`` bytes) is broadcast to the requests.
BROADCAST_RECORDS = 2048
#: A table of groups with at most this many rows is broadcast.
BROADCAST_GROUPS = 2048


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that can be told from any other when several are concatenated: ``-`` if null, else its bytes' count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


@dataclass(frozen=True)
class Manifest:
    """``root`` (None for an empty table); ``leaves``: the rows with ``tree`` (their group's number), ``rank`` and ``n`` (leaves of the group);
    ``groups``: tree, n, subroot; ``runs``: tree, n, at and digest of each first-level node; ``levels`` and ``upper``: records (digest, children)
    of each level of the groups' trees and of the tree over the groups."""

    root: str | None
    leaves: DataFrame
    groups: DataFrame
    runs: DataFrame
    levels: list[DataFrame]
    upper: list[DataFrame]


def _grown(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The records of each level over ``nodes`` (tree, n, at, digest), of which the largest tree has ``most``; and each tree's top."""
    levels, tops, width = [], [nodes.filter("n = 1")], 1
    while width < most:
        runs = nodes.filter(F.col("n") > width).groupBy("tree", "n", F.expr(f"at div {RUN}").alias("run"))
        level = runs.agg(F.array_sort(F.collect_list(F.struct("at", "digest")))["digest"].alias("children"))  # at most RUN
        level = level.select("tree", "n", F.col("run").alias("at"), digest(F.array_join("children", "")).alias("digest"), "children")
        levels.append(common.staged(level, f"level{len(levels)}"))
        width *= RUN
        nodes = levels[-1].drop("children")
        tops.append(nodes.filter((F.col("n") > width // RUN) & (F.col("n") <= width)))
    return levels, reduce(DataFrame.unionByName, tops)


def build(rows: DataFrame, group: str, key: str, leaf: str) -> Manifest:
    """The manifest of ``rows``: leaves (column ``leaf``) of a ``group`` go by ``key``, nulls first, then by their digest; groups by themselves, null first.

    Rows equal in group, key and leaf are interchangeable leaves of their own. Other columns stay with
    the leaves. An empty table has no root.
    """
    inner, at = common.shielded(rows)
    group, key, leaf = at[group], at[key], at[leaf]
    ordered = common.placed(inner, group, key, leaf)
    groups = ordered.groupBy(group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = common.placed(groups, "first").withColumnRenamed("place", "tree").withColumnRenamed(group, "of")
    n, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    known = F.broadcast(groups) if n <= BROADCAST_GROUPS else groups
    leaves = ordered.join(known, F.col(group).eqNullSafe(F.col("of"))).withColumn("rank", F.col("place") - F.col("first"))
    leaves = leaves.drop("of", "first", "place")
    nodes = leaves.select("tree", "n", F.col("rank").alias("at"), F.col(leaf).alias("digest"))
    levels, tops = _grown(nodes, most or 0)
    tops = common.staged(tops.select("tree", "n", F.col("digest").alias("subroot")), "subroots")
    over = tops.select(F.lit(0).alias("tree"), F.lit(n).cast("bigint").alias("n"), F.col("tree").alias("at"), F.col("subroot").alias("digest"))
    upper, top = _grown(over, n)
    root = top.select("digest").first()  # one row
    runs = nodes.filter("n = 1").unionByName(levels[0].drop("children")) if levels else nodes
    records = [_stored(x) for x in levels], [_stored(x) for x in upper]
    return Manifest(root and root[0], leaves, tops, runs, *records)


def _stored(level: DataFrame) -> DataFrame:
    """Records by content: equal nodes are one."""
    return level.select("digest", "children").dropDuplicates(["digest"])


def _chosen(requests: DataFrame, records: DataFrame, few: bool, digit: Column) -> DataFrame:
    """One level down: the child that ``digit`` chooses becomes ``digest``, the others are added to ``path``."""
    down = requests.join(F.broadcast(records) if few else records, "digest").withColumn("digit", digit.cast("int"))
    segment = _segment(F.col("children"), F.col("digit"))
    return down.withColumns({"path": F.array_append("path", segment), "digest": F.get("children", F.col("digit"))}).drop("children", "digit")


def _segment(children: Column, digit: Column) -> Column:
    """What stands left and right of a child."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"), F.array_join(F.slice(children, digit + 2, F.lit(RUN)), "").alias("right"))


def _digit(number: str, level: int) -> Column:
    return F.expr(f"({number} div {RUN**level}) % {RUN}")


def proofs(m: Manifest) -> DataFrame:
    """The leaves with ``subroot`` and ``path``: from the leaf to the root, what stands left and right of its node in each level's run.

    A level of a single node has no run and no segment. Requests start where their tree's root is: the
    tree over the groups gives every subroot its path, and a group's runs go down from its subroot.
    """
    empty = F.array().cast("array<struct<left:string,right:string>>")
    groups = m.groups.withColumns({"digest": F.lit(m.root), "path": empty})
    for level in reversed(range(len(m.upper))):
        few = m.upper[level].limit(BROADCAST_RECORDS + 1).count() <= BROADCAST_RECORDS
        groups = _chosen(groups, m.upper[level], few, _digit("tree", level))
    groups = common.staged(groups.select("tree", F.col("digest").alias("subroot"), "path"), "groups")
    known = F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups
    runs = m.runs.select("tree", "n", "at").join(known, "tree").withColumn("digest", F.col("subroot"))
    going = runs.filter(F.lit(False))
    for level in reversed(range(1, len(m.levels))):
        few = m.levels[level].limit(BROADCAST_RECORDS + 1).count() <= BROADCAST_RECORDS
        going = going.unionByName(runs.filter((F.col("n") > RUN**level) & (F.col("n") <= RUN ** (level + 1))))
        going = _chosen(going, m.levels[level], few, _digit("at", level - 1))
    going = going.unionByName(runs.filter(F.col("n") <= RUN))
    reached = going.filter("n > 1")
    if m.levels:
        reached = reached.join(m.levels[0], "digest")
    else:
        reached = reached.withColumn("children", F.array().cast("array<string>"))
    reached = reached.unionByName(going.filter("n = 1").withColumn("children", F.lit(None).cast("array<string>")))
    reached = reached.select(F.col("tree").alias("of"), "at", "subroot", F.reverse("path").alias("above"), "children")
    found = m.leaves.join(reached, (F.col("tree") == F.col("of")) & (F.expr(f"rank div {RUN}") == F.col("at")))
    own = F.when(F.col("children").isNotNull(), F.array(_segment(F.col("children"), _digit("rank", 0).cast("int")))).otherwise(empty)
    return found.withColumn("path", F.concat(own, "above")).drop("of", "at", "above", "children")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with this path."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def siblings(path: Column) -> Column:
    """All other nodes of the runs on the path, from the leaf's run to the root's, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def document_leaf(text: Column) -> Column:
    """The leaf of a row of ``documents`` with this text."""
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf with its proof; a fifth of the documents is tampered with before it is verified.

    A null id isn't tampered with; null fields have a digest of their own; equal rows are equal leaves.
    """
    docs = common.table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    shown = F.when(tampered, document_leaf(F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", "source", document_leaf(F.col("text")).alias("leaf"), shown.alias("shown"))
    m = build(rows, "source", "doc_id", "leaf")
    doc_id, leaf, shown = F.col("in0"), F.col("in2"), F.coalesce("in3", "in2")
    out = proofs(m).select(doc_id.alias("doc_id"), leaf.alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(shown, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(leaf_levels: int = 6, source_levels: int = 3) -> str:
    """DuckDB SQL with so many levels (of 16 each) at most."""

    def field(c: str) -> str:
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        """crc AS (SELECT doc_id AS id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))""",
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS shown FROM documents LEFT JOIN crc ON doc_id = id)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d)",
        "n0 AS (SELECT tree, rank AS pos, leaf AS digest FROM r)",
    ]

    def level(name: str, k: int) -> list[str]:
        before = "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        after = "ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
        run = f"PARTITION BY tree, (pos // {RUN})"
        return [
            f"{name}x{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, coalesce(string_agg(digest, '') OVER ({run} {before}), '') AS l, coalesce(string_agg(digest, '') OVER ({run} {after}), '') AS r FROM {name}{k})",
            f"{name}{k + 1} AS (SELECT tree, pos // {RUN} AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}x{k} GROUP BY tree, (pos // {RUN}))",
        ]

    for k in range(leaf_levels):
        ctes += level("n", k)
    ctes.append(f"s0 AS (SELECT 0 AS tree, tree AS pos, digest FROM n{leaf_levels})")
    for k in range(source_levels):
        ctes += level("s", k)
    out, state = "r", "f0 AS (SELECT r.*, shown AS now, '' AS proof FROM r)"
    ctes.append(state)
    step = 0
    for name, at, levels in (("n", "rank", leaf_levels), ("s", "tree", source_levels)):
        for k in range(levels):
            same = "x.tree = f.tree" if name == "n" else "true"
            ctes.append(f"f{step + 1} AS (SELECT f.* EXCLUDE (now, proof), CASE WHEN x.n = 1 THEN now ELSE sha256(x.l || now || x.r) END AS now, proof || x.l || x.r AS proof FROM f{step} AS f JOIN {name}x{k} AS x ON {same} AND x.pos = f.{at} // {RUN**k})")
            step += 1
    out = f"SELECT f.doc_id AS doc_id, leaf, n{leaf_levels}.digest AS subroot, s{source_levels}.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = s{source_levels}.digest AS verified FROM f{step} AS f JOIN n{leaf_levels} ON n{leaf_levels}.tree = f.tree, s{source_levels}"
    return "WITH " + ",\n".join(ctes) + "\n" + out


ORACLE = _oracle()
