"""Document fingerprints as invertible Bloom lookup tables (native: DataFrame and SQL functions only).

A text's paragraphs are hashed; each digest goes to three cells of a table, and a cell keeps the number of
its digests, their XOR and the XOR of their check hashes. The cells of two versions subtract, and peeling
(a cell with one digest gives it away, which frees others) recovers exactly the digests in which the
versions differ. If peeling stops early, it is tried again with more cells. A table is made of blocks of
cells, each for the digests of one residue, so the work grows with the length of the texts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, splitters

#: A paragraph is a line; longer lines are cut every so many code points.
LONGEST_PARAGRAPH = 256
#: A block has three tables of so many cells, for about so many digests of either text. Only cells that
#: aren't empty are kept, so room costs nothing.
CELLS, DIGESTS_PER_BLOCK = 128, 64
#: Tries; each has twice the blocks of the one before.
TRIES = 12

_CELL = "struct<i:int,c:int,k:bigint,h:bigint>"
_PEELED = "struct<p:bigint,s:int>"
_NONE = f"cast(array() as array<{_CELL}>)"


def digests(text: str) -> Column:
    """The distinct hashes of the paragraphs of a text (SQL text of a non-null string), sorted."""
    return F.expr(f"array_sort(array_distinct(transform(regexp_extract_all({text}, '[^\\\\n]{{1,{LONGEST_PARAGRAPH}}}', 0), p -> xxhash64(p))))")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks_for(n: str) -> str:
    """The least power of two of blocks for n digests."""
    return f"cast(power(2, greatest(0, ceil(log2(greatest(1, {n}) / {DIGESTS_PER_BLOCK}D)))) as int)"


def _in_blocks(units: list[str], blocks: str, body: str) -> str:
    """``body`` for each block 0 to ``blocks`` - 1, with ``$0``, ``$1``, ... standing for the digests that fall in it.

    Two levels, so that a long text isn't read once for each block.
    """
    pairs = lambda xs: "named_struct(" + ", ".join(f"'v{i}', {x}" for i, x in enumerate(xs)) + ")"
    inner = [f"if(nb = 1, gg.v{i}, filter(gg.v{i}, u -> (u & (nb - 1)) = g0 + b1 * ng))" for i in range(len(units))]
    fields = body
    for i in range(len(units)):
        fields = fields.replace(f"${i}", f"bb.v{i}")
    fine = f"transform(sequence(0, nb div ng - 1), b1 -> {_let('bb', pairs(inner), fields)})"
    outer = [f"if(ng = 1, {u}, filter({u}, u -> (u & (ng - 1)) = g0))" for u in units]
    grouped = f"transform(sequence(0, ng - 1), g0 -> {_let('gg', pairs(outer), fine)})"
    return _let("nb", f"cast({blocks} as int)", _let("ng", "cast(power(2, floor(log2(sqrt(nb)))) as int)", f"flatten({grouped})"))


def _merged(cells: str) -> str:
    """Cells by place, those of one place added up, without the empty ones."""
    push = "if(a.l.i < 0 or (a.l.c = 0 and a.l.k = 0 and a.l.h = 0), a.o, concat(a.o, array(a.l)))"
    add = "named_struct('o', a.o, 'l', named_struct('i', e.i, 'c', a.l.c + e.c, 'k', a.l.k ^ e.k, 'h', a.l.h ^ e.h))"
    start = f"named_struct('o', {_NONE}, 'l', named_struct('i', -1, 'c', 0, 'k', 0L, 'h', 0L))"
    return f"aggregate(array_sort({cells}), {start}, (a, e) -> if(a.l.i = e.i, {add}, named_struct('o', {push}, 'l', e)), a -> {push})"


def _places(h: str) -> list[str]:
    """The three cells of a check hash."""
    return [f"cast((shiftrightunsigned({h}, {8 * j}) & {CELLS - 1}) + {CELLS * j} as int)" for j in range(3)]


def _table(units: str, salt: str) -> str:
    """The cells of one block."""
    parts = ", ".join(_merged(f"transform(es, e -> named_struct('i', {p}, 'c', 1, 'k', e.k, 'h', e.x))") for p in _places("e.x"))
    return _let("es", f"transform({units}, u -> named_struct('k', u, 'x', xxhash64(u, {salt})))", f"concat({parts})")  # by table, and so by place


def _negative(cells: str) -> str:
    return f"transform({cells}, c -> named_struct('i', c.i, 'c', -c.c, 'k', c.k, 'h', c.h))"


def _peel(cells: str, salt: str) -> str:
    """A struct of o (the digests found, with the side that has them: 1 or -1) and ok (nothing is left)."""
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.c) = 1 and xxhash64(c.k, {salt}) = c.h), c -> named_struct('k', c.k, 'h', c.h, 's', c.c)))"
    taken = ", ".join(f"named_struct('i', {p}, 'c', -p.s, 'k', p.k, 'h', p.h)" for p in _places("p.h"))
    without = _merged(f"concat(s.cells, flatten(transform(ps, p -> array({taken}))))")
    found = "concat(s.o, transform(ps, p -> named_struct('p', p.k, 's', p.s)))"
    step = _let("ps", pure, f"if(size(ps) = 0, named_struct('cells', s.cells, 'o', s.o, 'more', false), named_struct('cells', {without}, 'o', {found}, 'more', true))")
    start = f"named_struct('cells', {cells}, 'o', cast(array() as array<{_PEELED}>), 'more', true)"
    return f"aggregate(sequence(1, {3 * CELLS + 1}), {start}, (s, r) -> if(s.more and size(s.cells) > 0, {step}, s), s -> named_struct('o', s.o, 'ok', size(s.cells) = 0))"


def sketch(units: str) -> Column:
    """The table of a digest array: for each block its cells that aren't empty. A text's blocks follow from its number of digests."""
    return F.expr(_in_blocks([units], _blocks_for(f"size({units})"), _table("$0", "0")))


def difference(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    """The digests that only one of two digest arrays has: array of (p: digest, s: 1 for the first, -1 for the second).

    cells_a, cells_b: columns with their sketches. These are subtracted and peeled; where one has fewer blocks,
    it is made again with as many. If peeling stops early, both are made again with twice the blocks and
    another hash, and so on. (After ``TRIES`` failures, which takes colliding hashes each time, the arrays are compared.)
    """
    all_ok = "if(forall(all, x -> x.ok), flatten(transform(all, x -> x.o)), null)"
    as_many = lambda cells, units: f"if(size({cells}) = nn, {cells}, {_in_blocks([units], 'nn', _table('$0', '0'))})"
    stored = f"zip_with({as_many(cells_a, a)}, {as_many(cells_b, b)}, (xx, yy) -> {_peel(_merged(f'concat(xx, {_negative("yy")})'), '0')})"
    first = _let("nn", f"greatest(size({cells_a}), size({cells_b}))", _let("all", stored, all_ok))
    subtracted = _merged(f"concat({_table('$0', 'try')}, {_negative(_table('$1', 'try'))})")
    larger = f"greatest(size({cells_a}), size({cells_b})) * cast(power(2, try) as int)"
    again = _let("all", _in_blocks([a, b], larger, _peel(subtracted, "try")), all_ok)
    found = f"aggregate(sequence(1, {TRIES - 1}), {first}, (got, try) -> if(got is null, {again}, got))"
    side = lambda x, y, sign: f"transform(array_except({x}, {y}), p -> named_struct('p', p, 's', {sign}))"
    return F.expr(f"coalesce({found}, concat({side(a, b, 1)}, {side(b, a, -1)}))")


def likeness(a: str, b: str, apart: str) -> Column:
    """Shared digests by all digests of both (1.0 if neither has any).

    apart: a column with the size of their difference, as recovered (a column, so that it is computed once).
    """
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, (size({a}) + size({b}) - {apart}) / cast(size({a}) + size({b}) + {apart} as double))")


def serialized(units: str, cells: str) -> Column:
    """A sketch as text: how many digests, then for each block its cells as place, count, XOR, check XOR in hex."""
    blocks = f"transform({cells}, block -> array_join(transform(block, c -> concat(lower(hex(c.i)), '.', c.c, '.', lower(hex(c.k)), '.', lower(hex(c.h)))), ','))"
    return F.concat_ws("|", F.expr(f"size({units})").cast("string"), F.expr(f"array_join({blocks}, ';')"))


_LAST = -(1 << 63)


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` (texts not null) with ``next``: the text of the row next by descending key; after the last comes the first.

    Null keys come last; rows of one key follow each other by the hash of their text, equal rows in any
    order. A single row is followed by itself. The table is range-partitioned by sampled splitters; each
    range also gets a copy of the row before its first, so no range waits for another. An input column
    named next gives way.
    """
    inner, at = common.shielded(df)
    return common.restored(_with_next(inner, at[key], at[text]), df.columns, "next")


def _with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    k, h, n, r, g = (common.fresh(df, x) for x in ("key", "hash", "size", "range", "ghost"))
    keyed = df.withColumns({k: F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)), h: F.xxhash64(text), n: F.octet_length(text).cast("bigint") + 16})
    ranges = splitters.split(common.staged(keyed.select(k, h, n), "keys"), k, h, n, 32)
    placed = keyed.withColumn(r, splitters.range_id(ranges.splitters, k, h))
    ends = {x[0]: (x[1], x[2]) for x in placed.groupBy(r).agg(F.max(F.struct(k, h)).alias("m")).select(r, f"m.{k}", f"m.{h}").collect()}  # a row a range
    order = sorted(ends)
    if not order:
        return df.withColumn("next", F.lit(None).cast("string"))
    before = [(i, *ends[order[at - 1]]) for at, i in enumerate(order)]
    spark = df.sparkSession
    ghosts = spark.createDataFrame(before, f"`{r}` int, __k bigint, __h bigint")
    ghosts = keyed.join(F.broadcast(ghosts), (F.col(k) == F.col("__k")) & (F.col(h) == F.col("__h")))  # at most splitters.MOST_RANGES
    both = placed.select(*df.columns, k, h, r, F.lit(1).alias(g)).unionByName(ghosts.select(*df.columns, k, h, r, F.lit(0).alias(g)))
    window = Window.partitionBy(r).orderBy(g, k, h)
    return both.withColumn("next", F.lag(text).over(window)).filter(F.col(g) == 1).select(*df.columns, "next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests("text").alias("own"), digests("edited").alias("other"), digests("next").alias("after"))
    rows = rows.withColumns({f"{c}_cells": sketch(c) for c in ("own", "other", "after")})
    rows = rows.withColumns({"apart_edited": F.size(difference("own", "other", "own_cells", "other_cells")), "apart_next": F.size(difference("own", "after", "own_cells", "after_cells"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", serialized("own", "own_cells").alias("fingerprint"), serialized("other", "other_cells").alias("edited_fingerprint"),
        likeness("own", "other", "apart_edited").alias("near_edited"), likeness("own", "after", "apart_next").alias("near_next"),
    )
