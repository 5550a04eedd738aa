"""Page text, the conversation trie and the Merkle manifest against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillmend.llm import convtrie, merkle, pagetext

# -- op11


def _weights(*pages):
    counts = Counter()
    for page in pages:
        counts.update(pagetext.count(page, pagetext._Cached()))
    return pagetext.Weights({k: (counts[k, True], counts[k, True] + counts[k, False]) for k in {k for k, _ in counts}})


def test_best_region_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.uniform(-3, 2) for _ in range(rng.randrange(12))]
        start, end = pagetext.best_region(scores)
        most = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
        assert sum(scores[start:end]) == pytest.approx(max(0, most))
    assert pagetext.best_region([]) == pagetext.best_region([-1.0]) == (0, 0)


def test_words_are_positive_and_tags_negative():
    page = "<html><body><nav><a href=x>menu</a></nav><article><h1>A title</h1><p>Some words of text</p></article><div class=ad>buy it</div></body></html>"
    weights = _weights(*[page] * 50)
    for key, value in weights.known.items():
        assert 0 < value < 1 and (weights.word(key) > 0 if key[0] == "w" else weights.tag(key) < 0)
    assert weights.word("w|in|p||") > 0.9 > 0.1 > weights.word("w|out|div||b") and weights.tag("t||p|") > weights.tag("t||nav|b")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", ""), ("plain &amp; simple", "plain & simple"), ("<!-- only --><script>var a = '<p>no</p>';</script>", ""),
        ("<article></article><nav>menu of words that are many</nav>", ""),
        ("<nav>a b c</nav><article><h1>Title &am</h1><p><b>One\n two<br><p>three&nbsp;&copy; 2 &lt; 3</p></article><footer>foot of page</footer>", "Title &am\nOne two\nthree © 2 < 3"),
        ("<article><p>One.</p><div class='ad'>Buy now</div><p>Two <a href='/x'>linked</a>.</p><aside>side</aside><form>Name <input></form><section id=comments><p>said a reader</p></section><p>End</p></article>", "One.\nTwo linked.\nEnd"),
        ("<div class=menu><a href=a>Home</a></div><div id=main><p>Text without any marker, told by what it is.</p><ul><li>First thing</li><li>Second thing</li></ul></div><div class=footer>All rights</div>", "Text without any marker, told by what it is.\nFirst thing\nSecond thing"),
        ("<main><header><h1>Head</h1></header><p>Body</p></main><header><p>Site name</p></header>", "Head\nBody"),
        ("<article class=comment><p>a reader says this</p></article><p>The real text stands outside of it.</p>", "The real text stands outside of it."),
        ("<p a='unclosed>one</p><p>two</p>", "one\ntwo"), ("<ARTICLE><P>Upper <STYLE>p{}</STYLE>case</P></ARTICLE>", "Upper case"),
        ("<article><p>See <a title='hidden gems' href=x>this</a> <b class=\"display:none\">too</b>.</p></article>", "See this too."),
        ("<article><p>a</p><div hidden><p>unseen</p></div><div style='display: none'>nor this</div></article>", "a"),
    ],
)
def test_main_text(page, text):
    with_markers = "<html><body><nav><a href=x>menu</a></nav><div class=ad>buy it</div><article><h1>A title</h1><p>Some words</p></article><footer>f</footer></body></html>"
    for weights in (_weights(), _weights(*[with_markers] * 30)):
        assert pagetext.main_text(page, weights) == text


def test_long_and_broken_pages_take_linear_time():
    weights, n = _weights(), 30_000
    for page in ("<div>" * n + "<p>x" * n, "<p a=\"" * n, "<b" * n, "<script>" * n, "</q>" * n + "<i>" * n + "<div>" * 100, "&" * n, "<!--" * n, "<p>" + "<b>" * n + "<div>" * n):
        assert pagetext.main_text(page, weights) is not None
    assert pagetext.main_text("<article><p>" + "word " * 500_000, weights) == " ".join(["word"] * 500_000)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = pagetext.query(spark, DATA).toPandas().set_index("page_id")
    raw = {r.page_id: r for r in pages.collect()}
    assert len(got) == len(raw)
    for page_id, r in raw.items():
        article = r.html.partition("<article>")[2].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", article)]
        assert got.text[page_id] == "\n".join(b for b in blocks if b) and got.n_chars[page_id] == len(got.text[page_id]) and got.url[page_id] == r.url
        hidden = r.html.replace("<article>", "<div>").replace("</article>", "</div>")  # no marker in this page: what was learned from others tells
        assert pagetext.main_text(hidden, _weights(*[x.html for x in raw.values() if x.page_id != page_id][:20])) == got.text[page_id]


def test_page_rows(spark):
    rows = [(None, None, "t"), (1, "", "t"), (1, "<p>same</p>", None), (1, "<p>same</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    weights = pagetext.learn(df, "html")
    out = pagetext.extract(df, "html", weights)
    assert out.columns == ["page_id", "html", "text", "n_chars"] and sorted(r.text for r in out.collect()) == ["", "", "same", "same"]
    assert pagetext.extract(df.limit(0), "html", pagetext.learn(df.limit(0), "html")).count() == 0


# -- op12

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain_trie(rows):
    """Every node by what its members are."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = turns.get(donor, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children, saved, leaves = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        cost = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not children[p]
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p))).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def _trie_of(spark, rows):
    df = spark.createDataFrame(rows, CONVERSATIONS)
    out = convtrie.summary(convtrie.build(*convtrie.rebuilt(convtrie.turns(df, "conv_id", "turn", "role", "text"))))
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in out.collect())


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "STRETCH", 4)
    monkeypatch.setattr(convtrie, "ENDS_PER_ROW", 3)
    rng = random.Random(5)
    rows = []
    for c in [*range(60), -3, -25, 400, 419]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", "", None])))
    rows += [(c, t, "user", f"turn {t // 3}") for c in (70, 71, 72, 73) for t in range(25)]  # long equal ones
    rows += [(80, None, "user", "first"), (80, 1, "user", "x"), (80, 1, "user", "x"), (80, 1, "user", "y"), (None, 1, "user", "no conversation")]
    assert _trie_of(spark, rows) == _plain_trie(rows)


def test_trie_of_few(spark):
    assert _trie_of(spark, [(None, 1, "user", "x")]) == []
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its only turn is replaced by a donor that isn't there
    rows = [(turnless, 0, "user", "x")]
    assert _trie_of(spark, rows) == _plain_trie(rows) and len(_plain_trie(rows)) == 1


def test_fat_search_takes_few_steps(spark):
    """The two-fattest number of an interval, and exits of conversations that part at any depth of a long one."""
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", convtrie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)
    rows = [(0, d, f"t{d}", 1) for d in range(1, 41)] + [(c, d, f"t{d}" if d <= c else f"own {c}", 1) for c in range(1, 40) for d in range(1, c + 3)]
    trie = convtrie.build(spark.createDataFrame(rows, "conv bigint, depth bigint, key string, words bigint"))
    nodes = trie.nodes().collect()
    # a branch below each depth, and its two turns; of every part of the long path one segment
    assert len(nodes) == 39 + 40 and sum(n.depth - n.pdepth for n in nodes) == 40 + 39 * 2
    found = {r.conv: r for r in trie.located(trie.convs).collect()}
    assert all(found[c].lcp == (c + 2 if c else 40) for c in range(40))


# -- op13


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _tree(leaves, run=16):
    """The root over leaves, and each leaf's (left, right) siblings from its run up."""
    paths, nodes = [[] for _ in leaves], list(leaves)
    of = list(range(len(leaves)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            a = of[i] - of[i] % run
            p.append(("".join(nodes[a : of[i]]), "".join(nodes[of[i] + 1 : a + run])))
            of[i] //= run
        nodes = [_h(*nodes[a : a + run]) for a in range(0, len(nodes), run)]
    return nodes[0], paths


def test_manifest_matches_brute_force(spark, tmp_path):
    rng = random.Random(13)
    sources = ["big"] * 300 + ["b", "B", "é", None, "", "two", "two"] + [f"s{i}" for i in range(40)] + [None] * 30
    rows = [(i * 7 % 379 - 20, f"Text {i} " * rng.randrange(3), rng.choice(["en", None]), s, rng.choice([i, None])) for i, s in enumerate(sources)]
    rows += [(5, None, None, "big", None), (None, "Null id", "en", "big", 7), (None, "", "en", "big", 7), (9, "Same", "en", "big", 4), (9, "Same", "en", "big", 4)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    leaf = lambda r, text: _h(*map(_field, (r[0], r[3], r[2], r[4], text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = _tree([trees[s][0] for s in names])
    expected = []
    for s, up in zip(names, above, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            lower = r[1] and "".join(c.lower() if c.isascii() else c for c in r[1])
            now = leaf(r, lower if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1])
            for a, b in path + up:
                now = _h(a, now, b)
            expected.append((r[0], own, trees[s][0], root, _h(*[x for ab in path + up for x in ab]), now, now == root))
    got = merkle.query(spark, str(tmp_path)).collect()
    order = lambda x: tuple(map(str, x))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=order) == sorted(expected, key=order)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_manifests(spark, n):
    df = spark.range(n).select(F.lit("s").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("rank"))  # names that the operator uses
    m = merkle.build(df, "tree", "id", "rank")
    got = merkle.proofs(m).select("in1", merkle.folded(F.col("in2"), F.col("path")).alias("folded"), F.size("path").alias("size")).collect()
    assert len(got) == n and all(r.folded == m.root and r.size == (n > 1) + (n > 16) for r in got) and (m.root is None) == (n == 0)
    if n:
        assert m.root == _tree([_h(str(i)) for i in range(n)])[0]


# -- places


def test_places(spark):
    """Gapless places in ascending order, nulls first, however the rows are dealt out; equal rows take any; none without rows."""
    from quillmend.llm import common

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 2, 2, -5]), rng.choice([None, "a", "B", "é", ""]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a bigint, b string, i bigint").repartition(7)
    got = sorted(common.placed(df, "a", "b").collect(), key=lambda r: r.place)
    order = lambda r: (r.a is not None, r.a or 0, r.b is not None, (r.b or "").encode())
    assert [r.place for r in got] == list(range(500)) and [order(r) for r in got] == sorted(order(r) for r in got) and sorted(r.i for r in got) == list(range(500))
    assert common.placed(df.limit(0), "a").count() == 0
    same = common.placed(spark.range(1000).select(F.lit(1).alias("a")), "a").collect()
    assert sorted(r.place for r in same) == list(range(1000))
