"""Plans and work of the queries that grew too fast: every text is read once, by as many tasks as there are, and folds of like documents are shared."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillmend import streaming
from quillmend.kernel import alike
from quillmend.kernel.fold import Fold
from quillmend.plans import ORACLE_SQL, QUERIES, queries
from quillmend.streaming import fold


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["relational_join", "relational_sets"])
def test_texts_are_read_once(spark, name):
    """No filter on what is read is pushed below, which reads the text again, before the rows are dealt out."""
    plan = _plan(QUERIES[name](spark, DATA))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("RoundRobinPartitioning")


_ONCE = ["stream_escaped", "stream_comments", "stream_damaged", "stream_fenced", "stream_long_string", "stream_lines", "stream_delta"]


@pytest.mark.parametrize("name", _ONCE)
def test_documents_stay_where_they_are(spark, name):
    """Chunks of one row are folded there: nothing is shuffled but the rows of a small file, nor is anything sorted."""
    plan = _plan(QUERIES[name](spark, DATA))
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning") and "Sort" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", [*_ONCE, "stream_verdict", "stream_fold"])
def test_like_documents_are_folded_once(spark, name, monkeypatch):
    """The documents of the query, folded here: far fewer chunks are pushed than there are, with the same outcome."""
    given = {}
    monkeypatch.setattr(streaming, "fold_lists", lambda df, key, chunks, **more: given.update(lists=[r[0] for r in df.select(chunks).collect()]) or _Stop.raised())
    monkeypatch.setattr(streaming, "fold_batch", lambda df, key, seq, chunk, **more: given.update(lists=_lists(df.select(key, seq, chunk).collect())) or _Stop.raised())
    with pytest.raises(_Stop):
        QUERIES[name](spark, DATA)
    pushed = []

    class Counted(Fold):
        def push(self, chunk, whole=True):
            pushed.append(chunk)
            return super().push(chunk, whole)

    plain, folds = alike.Folds(), alike.Folds()
    expected = [plain._plainly(c) for c in given["lists"]]
    monkeypatch.setattr(alike, "Fold", Counted)
    assert [folds.fold(c) for c in given["lists"]] == expected
    assert len(pushed) < sum(map(len, given["lists"])) / 2


@pytest.mark.parametrize("name", [*_ONCE, "stream_verdict", "stream_fold"])
def test_like_documents_are_filled_in_together(spark, name, monkeypatch):
    """A batch of the query's documents: no chunk of a known shape becomes an object of Python, and the columns are the same."""
    given = {}
    monkeypatch.setattr(streaming, "fold_lists", lambda df, key, chunks, **more: given.update(lists=[r[0] for r in df.select(chunks).collect()]) or _Stop.raised())
    monkeypatch.setattr(streaming, "fold_batch", lambda df, key, seq, chunk, **more: given.update(lists=_lists(df.select(key, seq, chunk).collect())) or _Stop.raised())
    with pytest.raises(_Stop):
        QUERIES[name](spark, DATA)
    lists, folds = given["lists"], alike.Folds()
    offsets, chunks = np.cumsum([0, *map(len, lists)]), pa.array([c for x in lists for c in x], pa.string())
    fold._changes(folds, offsets, chunks, folds.FIELDS)
    plainly, single = folds._plainly, []
    monkeypatch.setattr(folds, "_plainly", lambda x: single.append(x) or plainly(x))
    got = fold._changes(folds, offsets, chunks, folds.FIELDS)
    assert len(single) < len(lists) / 4
    expected = [plainly(x) for x in lists]
    for field in folds.FIELDS:
        assert got[field].to_pylist() == [v for x in expected for v in x[field]]


def test_a_long_text_is_cut_in_one_pass(spark):
    """A walk from the start of the text to each chunk takes minutes here."""
    began, n = time.perf_counter(), 1 << 20
    df = spark.range(1).select("id", F.expr(f"concat(repeat('é\\n', {n // 2}), '!')").alias("t"))
    got = queries._cut(df, "id", F.col("t"), 5).select(F.size("chunks").alias("n"), (F.array_join("chunks", "") == "é\n" * (n // 2) + "!").alias("same"), F.array_max(F.transform("chunks", F.length)).alias("most")).first()
    assert tuple(got) == (n // 5 + 1, True, 5)
    assert time.perf_counter() - began < 30


_ROWS = ["stream_verdict", "stream_fold"]


@pytest.mark.parametrize("name", _ROWS)
def test_chunks_stay_in_their_row(spark, name):
    """Chunks that are made of one row are neither shuffled nor sorted; only the rows of a small file are dealt out."""
    plan = _plan(QUERIES[name](spark, DATA))
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning") and "Sort" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", _ROWS)
def test_rows_of_one_id_are_documents_of_their_own(spark, name, tmp_path):
    """As in the SQL: a table with every row twice."""
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(300)
    events.union(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df, expected = QUERIES[name](spark, str(tmp_path)), duck.sql(ORACLE_SQL[name])
    at = [expected.columns.index(x) for x in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in expected.fetchall())


class _Stop(Exception):
    @classmethod
    def raised(cls):
        raise cls


def _lists(rows) -> list[list[str]]:
    found: dict = {}
    for k, _, c in sorted(rows):
        found.setdefault(k, []).append(c)
    return list(found.values())
