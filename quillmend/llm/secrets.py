"""Secret scans with multipart credential linking (native: DataFrame and SQL functions only).

Strong findings are assignments of passwords and the like, access key ids and long hexadecimal runs. Weak
candidates (account names, bare keys, endpoints) are common in clean text, so each is reported only when
a complementary part of a credential lies near it in the same scope (a block between blank lines). The
parts are joined by their intervals: sorted by place in their scope, each meets the nearest part of every
other role, so no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Strong kinds in their order: pattern (Java), the least length and the group that it holds for (0: the whole).
#: Runs of one class are matched at their least length at once; an assignment that is too short is found and
#: then dropped, because it keeps what it covers from being found otherwise.
STRONG = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
}
#: Weak kinds. A key and a host are whole runs of any length, so they are only tried where a run starts.
WEAK = {
    "login": (r"""\b(?:[Uu]ser(?:_?[Nn]ame)?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 0),
    "key": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/_=-])", 0, 0),
    "endpoint": (r"""https?://[^\s"'<>]{4,}|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b|(?<![A-Za-z0-9_.-])[a-z0-9-][a-z0-9.-]*(?<=\.(?:com|net|org|io|internal|local))(?![A-Za-z0-9_-])(?::[0-9]{2,5})?""", 0, 0),
}
#: What stands in every match of a kind, so that most texts need no search (kinds without an entry: anything).
HINTS = {"assign": (":", "="), "access": ("AKIA",), "login": (":", "="), "endpoint": (".",), "blank": ("\n",)}
ROLES = {"access": "identifier", "login": "account", "assign": "secret", "hex": "secret", "key": "secret", "endpoint": "endpoint"}
#: A weak part needs, this many code points away at most, a part of one of these roles.
NEEDS = {"identifier": ("secret",), "account": ("secret",), "secret": ("identifier", "account"), "endpoint": ("identifier", "secret")}
REACH = 200
#: Ends a scope.
BLANK = r"\n[ \t]*\n"

_SPANS = "array<struct<start:int,end:int,kind:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: str, kind: str, pattern: str) -> Column:
    """The leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hint = [F.contains(F.col(text), F.lit(h)) for h in HINTS.get(kind, ())]
    return F.when(reduce(lambda a, b: a | b, hint), found).otherwise(F.array().cast("array<string>")) if hint else found


def _running(lengths: Column) -> Column:
    """The sums of what comes before each element; by blocks of about the root of their number, so that no long array grows an element at a time."""
    total = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def blocked(xs: Column, width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / width).cast("int")), lambda j: total(F.slice(xs, j * width + 1, width)))
        return _let(parts, lambda ps: _let(total(F.transform(ps, lambda p: F.element_at(p, -1))), lambda before: F.flatten(F.transform(ps, lambda p, j: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: v + F.get(before, j))))))

    return _let(lengths, lambda xs: blocked(xs, F.ceil(F.sqrt(F.size(xs))).cast("int")))


def _spans(text: str, found: str, kind: str, pattern: str, least: int, group: int) -> Column:
    """Spans (start, end, kind) in code points of those matches (a column) that are long enough; the gaps between them are what a split leaves."""
    empty = F.expr(f"cast(array() as {_SPANS})")

    def placed(gaps: Column) -> Column:
        before = _running(F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, F.length), lambda g, n: g + n))
        firsts = F.zip_with(before, F.slice(gaps, 1, F.size(found)), lambda p, g: p + g)
        spans = F.zip_with(firsts, F.col(found), lambda p, m: F.struct(p.alias("start"), (p + F.length(m)).alias("end"), m.alias("m")))
        if least:
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["m"], pattern, group) if group else s["m"]) >= least)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.when(F.size(found) > 0, _let(F.transform(F.split(F.col(text), pattern, -1), F.length), placed)).otherwise(empty)


def _ranked(spans: Column) -> Column:
    """Sorted by start, then by kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate([*STRONG, *WEAK]) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan(df: DataFrame, text: str) -> DataFrame:
    """``df`` without its text, with ``strong`` and ``linked``: arrays of (start, end, kind), end exclusive, in code points.

    linked holds the weak candidates that a complementary part backs, without those that overlap a strong
    finding. Null and empty texts have none. Matches and places cost time in proportion to the text and its matches (a
    text of a million of them adds a factor of a few), and so do the windows in which parts of several roles meet, but for their sorts. Only texts with parts of two roles are looked at for weak
    candidates, as no other can have a linked one. Rows keep to themselves, equal ones too. Input columns
    named like the added ones give way to them.
    """
    inner, at = common.shielded(df)
    out = _scan(inner, at[text]).withColumn(at[text], F.lit(None))
    return common.restored(out, df.columns, "strong", "linked").drop(text)


def _scan(df: DataFrame, text: str) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    t, row, strong = common.fresh(df, "text"), common.fresh(df, "row"), "strong"
    at = {k: common.fresh(df, k) for k in [*STRONG, *WEAK, "blank"]}
    empty, none = F.expr(f"cast(array() as {_SPANS})"), F.array().cast("array<string>")
    some = lambda kinds: reduce(lambda a, b: a | b, [F.size(at[k]) > 0 for k in kinds])
    found = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    found = found.select(*keep, t, *[_matches(t, k, v[0]).alias(at[k]) for k, v in [*STRONG.items(), *WEAK.items()] if k != "endpoint"])
    # an endpoint needs a part of another kind; a doc with parts of one role alone has none that is linked
    found = found.withColumn(at["endpoint"], F.when(some([k for k in at if k not in ("endpoint", "blank")]), _matches(t, "endpoint", WEAK["endpoint"][0])).otherwise(none))
    roles = reduce(lambda a, b: a + b, [some([k for k, r in ROLES.items() if r == role]).cast("int") for role in NEEDS])
    found = found.withColumn("several", (roles > 1) & some(WEAK))
    found = found.withColumn(at["blank"], F.when(F.col("several"), _matches(t, "blank", BLANK)).otherwise(none))
    base = found.select(*keep, "several", _ranked(F.concat(*[_spans(t, at[k], k, *v) for k, v in STRONG.items()])).alias(strong),
                        F.when(F.col("several"), F.concat(*[_spans(t, at[k], k, *v) for k, v in WEAK.items()], _spans(t, at["blank"], "blank", BLANK, 0, 0))).otherwise(empty).alias("weak"),
                        F.monotonically_increasing_id().alias(row))
    base = common.staged(base, "parts")  # fixes the row numbers

    each = base.filter("several").select(row, F.explode(F.concat("weak", strong)).alias("p")).select(row, "p.*")
    each = each.withColumn("role", F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("kind")])
    place = ("start", "end", "kind")
    before, after = (Window.partitionBy(row).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (place, _backwards(place)))
    sure = lambda c: F.when(F.col("kind").isin(list(STRONG)), c)
    each = each.withColumns({
        "scope": F.coalesce(F.sum((F.col("kind") == "blank").cast("int")).over(before), F.lit(0)),
        "covered": F.coalesce(F.max(sure(F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(sure(F.col("start"))).over(after) < F.col("end"), F.lit(False)),
    }).filter((F.col("kind") != "blank") & (F.col("kind").isin(list(STRONG)) | ~F.col("covered")))
    left, right = (Window.partitionBy(row, "scope").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (place, _backwards(place)))
    near = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("end"))).over(left) >= F.col("start") - REACH, F.lit(False)) | F.coalesce(
        F.min(F.when(F.col("role") == role, F.col("start"))).over(right) <= F.col("end") + REACH, F.lit(False)
    )
    each = each.withColumns({f"near_{r}": near(r) for r in NEEDS})
    backed = reduce(lambda a, b: a | b, [(F.col("role") == r) & reduce(lambda a, b: a | b, [F.col(f"near_{x}") for x in needs]) for r, needs in NEEDS.items()])
    linked = each.filter(F.col("kind").isin(list(WEAK)) & backed).groupBy(row).agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    out = base.select(*keep, strong, row).join(linked, row, "left")
    return out.select(*keep, strong, _ranked(F.coalesce("linked", empty)).alias("linked"))


def _backwards(place: tuple[str, ...]) -> list[Column]:
    """The reverse order: what follows a row comes before it there, and Spark keeps a running value of what comes before only."""
    return [F.col(c).desc() for c in place]


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's findings: the strong ones by kind and digest, and all with the linked ones."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = [F.expr(f"cast(size(filter(strong, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in STRONG]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(_ranked(F.concat("strong", "linked"))).alias("spans"))
