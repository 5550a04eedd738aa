"""The pipeline's stages against what each must leave."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline as cp
import regex
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import _sets, _words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# -- each stage in plain Python


def _near_kept(rows):
    """Ids that stay: of rows linked from 80 hundredths on, directly or through others, the least."""
    sets = {d: _sets(t) for d, t in rows}
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for x, y in combinations(sorted(sets), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            low, high = sorted((root(x), root(y)))
            group[high] = low
    return {d for d in sets if root(d) == d}


def _clean(rows, items):
    """Ids of texts of which less than a twentieth of the words lie in windows of 13 words of the items."""
    windows = set()
    for t in items:
        ws = _words(t)
        m = min(13, len(ws))
        windows |= {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)} if ws else set()
    out = set()
    for d, t in rows:
        ws, hit = _words(t), set()
        for m in {len(w) for w in windows}:
            for i in range(len(ws) - m + 1):
                if tuple(ws[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
        if not hit or 20 * len(hit) < len(ws):
            out.add(d)
    return out


def _mixed(rows):
    """How often each id is taken: sources share 150 % of the words by weights 3, 1, 2, none above twice its own; the rest by a seeded order."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while full := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2 * total[s]]:
        for s in full:
            target[s] = 2.0 * total[s]
            open_.discard(s)
        left = 1.5 * sum(total.values()) - sum(target.values())
        if not open_:
            break
    for s in open_:
        target[s] = left * weight[s] / sum(weight[x] for x in open_)
    taken = {}
    for s in sources:
        whole = math.floor(target[s] / total[s] + 1e-12) if total[s] else 0
        part, run = target[s] - whole * total[s], 0
        for d, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: int(hashlib.md5(f"20:{r[0]}".encode()).hexdigest()[:15], 16)):
            taken[d] = whole + (run + size[d] / 2 < part)
            run += size[d]
    return {d: n for d, n in taken.items() if n}


def _sharded(rows):
    """Shard and slot of each (id, text), by the hashes of text and id: a row goes where the middle of its bytes lies."""
    key = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    size = [len((t or "").encode()) + 16 for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (key(rows[i][1] or ""), key(str(rows[i][0]))))
    total, before, slots, out = sum(size), 0, Counter(), []
    for i in order:
        shard = min(39, (2 * before + size[i]) * 40 // (2 * total))
        out.append((rows[i][0], shard, slots[shard]))
        slots[shard] += 1
        before += size[i]
    return sorted(out)


def test_stages_match_brute_force(spark):
    """Each stage on what the one before kept, with nulls, empty texts, near copies and benchmark passages among the rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    base = " ".join(f"near{i}" for i in range(90))
    extra = [(10_001, None, "en", "src0", 0), (10_002, "", None, None, 0), (10_003, "... 12 !", "de", "src1", 8), (10_004, base, None, None, 0), (10_005, base + " " + " ".join(f"x{i}" for i in range(15)), None, "src0", 0), (10_006, items[0], "en", "src0", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    stage, rows = dict(cp.STAGES), docs.collect()
    told = stage["language ID"](spark, docs, DATA).cache()
    got = {r.doc_id: r for r in told.collect()}
    assert told.columns == COLUMNS and set(got) == {r.doc_id for r in rows if regex.search(r"\p{L}", r.text or "")}
    assert all(got[r.doc_id].lang == r.lang for r in rows if r.lang is not None and r.doc_id in got) and all(r.lang for r in got.values())
    single = stage["MinHash near-dedup"](spark, told, DATA).cache()
    left = single.collect()
    assert single.columns == COLUMNS and sorted(r.doc_id for r in left) == sorted(_near_kept([(r.doc_id, r.text) for r in got.values()]))
    clean = stage["benchmark decontamination"](spark, single, DATA).cache()
    rest = clean.collect()
    assert clean.columns == COLUMNS and sorted(r.doc_id for r in rest) == sorted(_clean([(r.doc_id, r.text) for r in left], items)) and 10_006 not in {r.doc_id for r in rest}
    mixed = stage["mixing sources"](spark, clean, DATA).cache()
    assert mixed.columns == COLUMNS and dict(Counter(r.doc_id for r in mixed.collect())) == _mixed([(r.doc_id, r.text, r.source) for r in rest])
    sharded = stage["sharding"](spark, mixed, DATA)
    placed = _sharded([(r.doc_id, r.text) for r in mixed.collect()])
    assert sharded.columns == [*COLUMNS, "shard", "slot"]
    by_id = lambda xs: sorted((d, s) for d, s, _ in xs)  # noqa: E731  copies of one row may swap their slots
    found = [(r.doc_id, r.shard, r.slot) for r in sharded.collect()]
    assert by_id(found) == by_id(placed) and sorted((s, k) for _, s, k in found) == sorted((s, k) for _, s, k in placed)


def test_near_copies_below_the_query(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, base, "en", "a", 0), (2, base + " " + " ".join(f"x{i}" for i in range(20)), "en", "a", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in dict(cp.STAGES)["MinHash near-dedup"](spark, docs, DATA).collect()] == [1]


def test_language_without_labels(spark):
    rows = [(i, t, None, "a", 0) for i, t in enumerate(["plain words", "é", "Привет", "123 !", "", None, " \n"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    told = dict(cp.STAGES)["language ID"](spark, docs, DATA)
    assert {r.doc_id for r in told.collect()} == {0, 1, 2} and told.columns == COLUMNS


def test_rows_of_null_and_repeated_ids(spark):
    stage = dict(cp.STAGES)
    bad = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").first().text
    clean = [" ".join(f"c{i}w{k}" for k in range(60)) for i in range(4)]
    rows = [(None, clean[0]), (None, clean[0]), (None, clean[1]), (None, bad), (7, clean[2]), (7, clean[2]), (7, clean[3]), (7, bad), (8, clean[3]), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    key = lambda x: (str(x[0]), str(x[1]))
    single = stage["MinHash near-dedup"](spark, docs, DATA)
    assert sorted([(r.doc_id, r.text) for r in single.collect()], key=key) == sorted([(None, clean[0]), (None, clean[1]), (None, bad), (7, clean[2]), (7, clean[3]), (9, None)], key=key)
    got = stage["benchmark decontamination"](spark, docs, DATA)
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted([x for x in rows if x[1] != bad], key=key)
    assert single.columns == got.columns == COLUMNS


def test_clashing_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ["shard", "slot", "score", "lang_pred", "target", "repeats", "source_size", "kept", "id", "n", "in0", "mix_size", "copy", "key_text", "__range", "bad_id", "component_id"]
    for c in names:
        docs = docs.withColumn(c, F.lit("own"))
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
        if name != "sharding":
            assert docs.columns == columns
            assert docs.filter(" and ".join(f"`{c}` = 'own'" for c in names)).count() == docs.count() > 0
    assert docs.columns == [c for c in columns if c not in ("shard", "slot")] + ["shard", "slot"]


def test_run(spark):
    out = cp.run(spark, DATA)
    assert out.count() > 0 and out.columns == [*COLUMNS, "shard", "slot"]


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
