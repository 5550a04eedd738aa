"""Near-duplicate documents by banded MinHash with odd sketches.

Texts become sets of hashed word shingles. Equal sets form one class at once. A class has 64 MinHash
samples (more for links below 0.85); bands of four samples are the buckets in which candidates meet, and all samples are folded into an
odd sketch, a bitmap of parities: the population count of the XOR of two of them tells how many samples
differ. Candidates whose sketches are near enough are confirmed on their full sets.

Buckets may be huge, so their pairs are never listed. In each round a bucket's pivot is compared with its
other members; whoever is linked shares a component then, and only members still apart go on, with
sixteen times the pivots. Of those, shingles that none of the others has bound how similar a pair can be. Two members
of a bucket are left uncompared only if they are in one component already, or if that bound or their sketches
rule a link out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
SAMPLES, BAND_ROWS = 64, 4
BANDS = SAMPLES // BAND_ROWS
SKETCH_BITS = 512
#: A pair is dropped on its sketches when they differ as they would so many standard deviations of the
#: samples below the similarity that a link needs: a link strays so far less than once in a million pairs.
DEVIATIONS = 6.05
#: A link of the query: shared shingles are at least so many hundredths of all shingles of both.
PERCENT = 85
#: Links of fewer hundredths aren't supported; they would need longer sketches.
LEAST_PERCENT = 80
#: Bands are enough to miss a pair at the link's similarity this often at most (16 bands at 85, 23 at 80).
MISS = 7.5e-6
#: So many ids are broadcast at most (8 bytes each); beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.Generator(np.random.PCG64(85))
_MULTIPLY = _draw.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_MORE = 32  # samples beyond the query's
_MULTIPLY = np.concatenate([_MULTIPLY, _draw.integers(1, 1 << 63, _MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
_ADD = np.concatenate([_ADD, _draw.integers(0, 1 << 63, _MORE, dtype=np.uint64)])
_CHUNK, _WORDS_KEPT = 4096, 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: _Words) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of five words; of the whole sequence if it is shorter.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Null and empty texts have none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _P + h[i : i + n]
    return np.unique(_mix(out))


def bands_for(percent: int) -> int:
    """The bands that find links of so many hundredths or more."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"links of {percent} hundredths")
    return 1 if percent == 100 else int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** BAND_ROWS))))


def sketch_limit(percent: int) -> int:
    """The bits in which the sketches of a link of so many hundredths differ at most."""
    similarity, count = percent / 100, bands_for(percent) * BAND_ROWS
    return most_apart(similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / count), count)


def samples(found: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """The MinHash samples of a non-empty set of hashes."""
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _CHUNK):  # bounds the memory for very long texts
        least = np.minimum(least, (found[None, i : i + _CHUNK] * _MULTIPLY[:count, None] + _ADD[:count, None]).min(axis=1))
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Samples folded into parities: each flips the bit that its number and value choose."""
    bit = _mix(least + _P * np.arange(1, len(least) + 1, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    parity = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)


def most_apart(similarity: float, count: int = SAMPLES) -> int:
    """The bits in which sketches differ, on average, at a similarity."""
    apart = 2 * count * (1 - similarity)
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * apart / SKETCH_BITS)))


_SIGNED = "n bigint, c1 bigint, c2 bigint, bands array<bigint>, sketch array<bigint>"


def _signed(batches: Iterator[pa.RecordBatch], in_bands: int) -> Iterator[pa.RecordBatch]:
    known = _Words()
    with np.errstate(over="ignore"):
        for batch in batches:
            n, c1, c2, bands, sketch = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), known)
                n.append(len(found))
                c1.append(int(_mix(found + _P).sum(dtype=np.uint64).astype(np.int64)))
                c2.append(int(np.bitwise_xor.reduce(_mix(found ^ _M2)).astype(np.int64)) if len(found) else 0)
                if not len(found):
                    bands.append([])
                    sketch.append([])
                    continue
                least = samples(found, in_bands * BAND_ROWS)
                key = np.arange(1, in_bands + 1, dtype=np.uint64)
                for row in least.reshape(in_bands, BAND_ROWS).T:
                    key = _mix(key * _P + row)
                bands.append(key.view(np.int64))
                sketch.append(odd_sketch(least))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names=["id", "n", "c1", "c2", "bands", "sketch"])
    known.clear()
    common.release()


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text of a, text of b), those that the full sets link."""
    known, last, own = _Words(), None, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(ta.as_py(), known)
                other = shingles(tb.as_py(), known)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(own) + len(other) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
    known.clear()
    common.release()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of some documents; ``ids`` is staged and distinct."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def _apart(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _linked(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: first by their sketches, then by their full sets."""
    s = sketches.select(F.col("id"), "sketch")
    near = pairs.join(s.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")
    return _confirm(common.staged(near.filter(_apart(F.col("sa"), F.col("sb")) <= sketch_limit(percent)).select("a", "b"), "near"), docs, percent)


def _confirm(near: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b; staged), those that the full sets link."""
    ids = common.staged(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = _texts(docs, ids)
    rows = near.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
    kind = dict(near.dtypes)["a"]
    return common.staged(rows.select("a", "b", "ta", "tb").mapInArrow(lambda batches: _confirmed(batches, percent), f"a {kind}, b {kind}"), "links")


def _lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingle) of rows (id, text)."""
    known = _Words()
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), known)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int64)), pa.array(found.view(np.int64))], names=["id", "shingle"])


def _possible(n: str, alone: str, m: str, lone: str, percent: int) -> Column:
    """Whether two sets can be linked: of n and m shingles, ``alone`` and ``lone`` are in no other set."""
    n, alone, m, lone = (F.col(x) for x in (n, alone, m, lone))
    return 100 * F.least(n - alone, m - lone) >= percent * (alone + lone + F.greatest(n - alone, m - lone))


def _linkable(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The members (bucket, id, component) that can still have a link in their bucket, with n, bands and ``alone``.

    alone: shingles of a document that no other document of all open buckets has. They are in no
    intersection and in every union, so a pair's similarity is bounded; a member that is ruled out even
    with the partner in its bucket that has the fewest of them goes.
    """
    members = common.staged(members, "apart")
    ids = common.staged(members.select("id").distinct(), "ids")
    each = _texts(docs, ids).select("id", "text").mapInArrow(_lone, "id bigint, shingle bigint")
    lone = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    known = ids.join(lone, "id", "left").join(classes.select("id", "n", "bands", "sketch"), "id").select("id", "n", "bands", "sketch", F.coalesce("alone", F.lit(0)).alias("alone"))
    rated = common.staged(members.join(known, "id"), "rated")
    # the least that a partner can have: the second least where the member itself has the least
    least = rated.groupBy("bucket").agg(F.min("alone").alias("least"), F.min_by("id", "alone").alias("by"), F.count(F.lit(1)).alias("k"))
    rated = common.staged(common.counted_join(rated, least, ["bucket"], "k"), "least")
    second = rated.groupBy("bucket").agg(F.min(F.when(F.col("id") != F.col("by"), F.col("alone"))).alias("second"), F.count(F.lit(1)).alias("k")).filter("second is not null")
    best = common.counted_join(rated, second, ["bucket"], "k").withColumn("partner", F.when(F.col("id") == F.col("by"), F.col("second")).otherwise(F.col("least")))
    return best.filter(100 * (F.col("n") - F.col("alone")) >= percent * (F.col("n") + F.col("partner"))).select("bucket", "id", "component", "n", "alone", "bands", "sketch")


def _dealt(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """``members`` with each of ``chosen`` of their bucket; the members of a hot bucket are dealt out, and each part gets all that are chosen."""
    per_bucket = common.staged(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")), "sizes")
    least = common.hot_from(int(per_bucket.agg(F.sum("k")).first()[0] or 0))
    hot = F.broadcast(per_bucket.filter(F.col("k") >= least).select("bucket", F.ceil(F.col("k") / common.HOT_ROWS).cast("int").alias("parts")))
    own = members.join(hot, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")).drop("parts")
    theirs = chosen.join(hot, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return own.join(theirs, ["bucket", "part"])


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after more links (a, b)."""
    for end in ("a", "b"):
        links = links.join(labels.withColumnRenamed("component", "c"), F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("c", end)).select("a", "b")
    merged = components(links, "a", "b").withColumnsRenamed({"node": "was", "component": "now"})
    old = labels.join(merged, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    new = merged.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return common.staged(old.union(new), "labels")


def near_duplicates(df: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) for every row of ``df``.

    Links are pairs of a similarity of ``percent`` hundredths or more. key: a bigint column. component_id is the least key that links lead to, the row's own included; kept
    where it is the row's own. Rows of one key are one document as far as links go. Rows with a null key
    have no component (null) and are kept. Null and empty texts have no shingles and no links. An empty
    table gives an empty result. Other columns of ``df`` aren't looked at.
    """
    in_bands = bands_for(percent)
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = common.staged(docs.mapInArrow(lambda batches: _signed(batches, in_bands), f"id bigint, {_SIGNED}"), "signed")
    docs = docs.filter(F.col("id").isNotNull())
    worded = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    # classes of equal sets; the sketches of a class are equal too
    classes = worded.groupBy("n", "c1", "c2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = common.staged(classes, "classes")
    met = classes.select(F.col("id"), F.explode("bands").alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = common.staged(common.counted_join(met, buckets, ["bucket"], "members").select("bucket", "id", "pivot"), "members")
    pairs = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = common.staged(pairs, "pairs")
    links, tried, pivots = _linked(pairs, classes, docs, percent), pairs, 1
    # equal sets of different rows of one key link classes, too
    same = worded.join(classes.withColumnRenamed("id", "a").select("n", "c1", "c2", "a"), ["n", "c1", "c2"]).filter("a <> id").select("a", F.col("id").alias("b"))
    members = members.filter("id <> pivot").select("bucket", "id")
    labels = components(links, "a", "b")
    while True:
        at = members.join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        at = common.staged(at, "at")
        open_ = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo < hi").select("bucket", "k")
        members = common.staged(_linkable(common.counted_join(at, open_, ["bucket"], "k"), classes, docs, percent), "open")
        if members.isEmpty():
            break
        pivots *= 16
        salt = F.pmod(F.xxhash64("id", F.lit(pivots)), F.lit(pivots))
        chosen = members.groupBy("bucket", salt.alias("salt")).agg(F.min_by(F.struct("id", "component", "n", "alone", "bands", "sketch"), "id").alias("p"))
        chosen = common.staged(chosen.select("bucket", F.col("p.id").alias("a"), F.col("p.component").alias("ca"), F.col("p.n").alias("na"), F.col("p.alone").alias("ua"), F.col("p.bands").alias("ba"), F.col("p.sketch").alias("sa")), "chosen")
        # a pair counts in the first bucket that it shares; there it has been compared, or is now
        first = F.expr("filter(zip_with(bands, ba, (x, y) -> if(x = y, x, null)), v -> v is not null)[0] = bucket")
        marked = members.join(chosen.select("bucket", F.col("a").alias("id"), F.lit(True).alias("is_pivot")), ["bucket", "id"], "left")
        marked = common.staged(marked.withColumn("is_pivot", F.coalesce("is_pivot", F.lit(False))), "marked")
        once = ~F.col("is_pivot") | (F.col("a") < F.col("id"))  # two pivots meet one way round
        pairs = _dealt(marked, chosen).filter(once & (F.col("component") != F.col("ca")) & _possible("n", "alone", "na", "ua", percent) & first & (_apart(F.col("sketch"), F.col("sa")) <= sketch_limit(percent)))
        pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        pairs = common.staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        more = _confirm(pairs, docs, percent)
        members = marked.filter(~F.col("is_pivot")).select("bucket", "id")
        if not more.isEmpty():
            links = links.union(more)
            labels = _relabelled(labels, more)
    repeated = worded.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    if not repeated.isEmpty():  # one key with several texts: its classes hang together
        labels = components(links.unionByName(same.join(repeated, F.col("b") == F.col("id"), "left_semi")), "a", "b")
    by_class = classes.select("n", "c1", "c2", F.col("id").alias("rep")).join(labels, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select("n", "c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    own = signed.select("id", "n", "c1", "c2").join(by_class, ["n", "c1", "c2"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return own.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), "doc_id", "text", PERCENT).withColumnRenamed("id", "doc_id")


#: Equal sets of documents are one there, too; pairs come from shared shingles.
ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s
), c AS (SELECT min(doc_id) AS rep, sh, any_value(n) AS n FROM n WHERE n > 0 GROUP BY sh
), e AS (SELECT rep, n, hash(unnest(sh)) AS h FROM c
), p AS (
  SELECT x.rep AS a, y.rep AS b FROM e x JOIN e y ON x.h = y.h AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), r AS (
  WITH RECURSIVE t(a, b) AS (
    SELECT rep, rep FROM c UNION SELECT t.a, q.b FROM t JOIN (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) q ON t.b = q.a
  ) SELECT a, min(b) AS component FROM t GROUP BY a
)
SELECT n.doc_id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(r.component, n.doc_id) AS component_id, coalesce(r.component, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN c ON n.sh = c.sh LEFT JOIN r ON c.rep = r.a
"""
