"""Toxicity by compression distance.

Two zstandard dictionaries share the words that are frequent in both classes; one goes on with what toxic
texts hold more often than ordinary ones, the other with the reverse. A window of words that the toxic
dictionary packs into fewer bytes than the ordinary one speaks for toxicity, also where only a part of
a word (a stem) is known. The windows' differences are condensed to a few numbers a text, and a logistic
curve over them, fitted on labelled texts that the dictionaries haven't seen, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words to a window; windows follow each other from the first word to the last.
WINDOW = 6
#: About so many labelled rows of each class are learned from, drawn by a hash of the id.
FIT_ROWS = {1: 6_000, 0: 12_000}
#: One in so many of them calibrates, the others fill the dictionaries.
CALIBRATE_ONE_IN = 3
#: A word counts once for each pair of neighbours that it has; rarer ones aren't looked at.
LEAST_CONTEXTS = 5
#: Words of the dictionaries: shared ones, and contrasting ones by their z score.
SHARED_WORDS, CONTRAST_WORDS, LEAST_Z = 2_000, 400, 5.0
#: A contrasting word is this many times as frequent in its class.
LEAST_RATIO = 4.0
THRESHOLD = 0.7
SEED = 6

_TRIM = b".,!?#$%&*|;:\"'()[]"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


@dataclass(frozen=True)
class Model:
    """toxic, ordinary: dictionary contents (None if a class had no rows); the rest turns features into a score."""

    toxic: bytes | None
    ordinary: bytes | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


def _measure(toxic: bytes, ordinary: bytes) -> Callable[[str | None], list[float]]:
    """Features of a text: the largest, second and fourth largest difference of its windows, their mean, and the log of how many there are."""
    a, b = _compressor(toxic), _compressor(ordinary)

    def features(text: str | None) -> list[float]:
        ws = tokens(text)
        windows = [b" " + b" ".join(ws[i : i + WINDOW]) + b" " for i in range(0, max(1, len(ws)), WINDOW)]
        d = sorted((len(b.compress(w)) - len(a.compress(w)) for w in windows), reverse=True)
        n = len(d)
        return [float(d[0]), float(d[min(1, n - 1)]), float(d[min(3, n - 1)]), sum(d) / n, math.log(n)]

    return features


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = set()
        for text, label in zip(frame["text"], frame["label"], strict=True):
            ws = [w.strip(_TRIM) for w in tokens(text)]
            rows.update((int(label), p, w, n) for p, w, n in zip([b"", *ws], ws, [*ws[1:], b""], strict=False) if len(w) > 1)
        yield pd.DataFrame(list(rows), columns=["label", "p", "w", "n"])


def _dictionaries(fit: DataFrame) -> tuple[bytes, bytes]:
    """Dictionary contents from rows (text, label); the driver gets counts of words of the bounded sample."""
    seen = fit.mapInPandas(_contexts, "label int, p binary, w binary, n binary").distinct()
    counts = seen.groupBy("w").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o"))
    counts = common.staged(counts, "contexts")
    total = counts.agg(F.sum("t"), F.sum("o")).first()
    nt, no = max(1, total[0] or 0), max(1, total[1] or 0)
    rows = counts.filter(F.col("t") + F.col("o") >= LEAST_CONTEXTS).collect()
    z, df = {}, {}
    for r in rows:
        w, p = bytes(r.w), (r.t + r.o) / (nt + no)
        df[w] = r.t + r.o
        if len(w) >= 3:
            z[w] = (r.t / nt - r.o / no) / math.sqrt(p * (1 / nt + 1 / no))
    by_z = sorted(z, key=lambda w: (-z[w], w))
    counted = {bytes(r.w): (r.t, r.o) for r in rows}
    apart = lambda w: counted[w][0] * no >= LEAST_RATIO * max(1, counted[w][1]) * nt
    toxic = [w for w in by_z if z[w] > LEAST_Z and apart(w)][:CONTRAST_WORDS]
    ordinary = by_z[::-1][: len(toxic)]
    shared = [w for w in sorted(df, key=lambda w: (-df[w], w)) if w not in set(toxic)][:SHARED_WORDS]
    # the shared words come last and so equally far from a window in both; only the contrasting ones make a difference
    content = lambda ws: b" " + b" ".join(reversed(ws)) + b" "
    size = max(len(content(toxic)), len(content(ordinary)))
    return content(toxic).rjust(size) + content(shared), content(ordinary).rjust(size) + content(shared)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(df: DataFrame, key: str, text: str, label: Column) -> Model:
    """A model from the rows whose label is 0 or 1; rows with another or a null label are left out.

    At most about ``FIT_ROWS`` rows of each class are used, drawn by a hash of the key, so reruns agree.
    Without rows of both classes every score is the share of label 1 (0 without any rows).
    """
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = df.select(F.col(text).alias("text"), label.cast("int").alias("label"), unit.alias("unit"), F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 1)), F.lit(CALIBRATE_ONE_IN)).alias("part")).filter(F.col("label").isin(0, 1))
    rows = common.staged(rows.filter(F.col("unit") < F.when(F.col("label") == 1, _share(df, label, 1)).otherwise(_share(df, label, 0))), "labelled")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    nothing = np.zeros(0)
    if len(n) < 2:
        return Model(None, None, nothing, nothing, nothing, float(1 in n))
    fit, held = rows.filter("part <> 0"), rows.filter("part = 0")
    toxic, ordinary = _dictionaries(fit)

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = _measure(toxic, ordinary)
        for frame in frames:
            yield pd.DataFrame([[*features(t), y] for t, y in zip(frame["text"], frame["label"], strict=True)], columns=["a", "b", "c", "d", "e", "y"])

    got = held.select("text", "label").mapInPandas(featured, "a double, b double, c double, d double, e double, y double").toPandas().sort_values(["a", "b", "c", "d", "e", "y"]).to_numpy(float)
    rate = n[1] / (n[0] + n[1])
    if not len(got) or not 0 < got[:, 5].mean() < 1:
        return Model(None, None, nothing, nothing, nothing, rate)
    mean, scale = got[:, :5].mean(0), got[:, :5].std(0) + 1e-9
    x = np.hstack([np.ones((len(got), 1)), (got[:, :5] - mean) / scale])
    return Model(toxic, ordinary, mean, scale, _logistic(x, got[:, 5]), rate)


def _share(df: DataFrame, label: Column, value: int) -> float:
    """The share of the class's rows that the sample takes."""
    return min(1.0, FIT_ROWS[value] / max(1, df.filter(label == value).count()))


def score(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with ``score`` (0 to 1). Every window of the whole text counts; null and empty texts are one empty window.

    An input column named score gives way.
    """
    inner, at = common.shielded(df)
    return common.restored(_score(inner, at[text], model), df.columns, "score")


def _score(df: DataFrame, text: str, model: Model) -> DataFrame:
    at = df.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = _measure(model.toxic, model.ordinary) if model.toxic is not None else None
        for frame in frames:
            if features is None:
                yield frame.assign(score=model.rate)
                continue
            x = np.array([features(t) for t in frame.iloc[:, at]]).reshape(-1, 5)
            x = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale])
            yield frame.assign(score=1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))

    return df.mapInPandas(scored, f"{fields}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labelled rows that aren't held out."""
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    known = labels.filter(common.id_remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isNotNull())
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    known = common.staged(known, "labels")
    taken = F.when(F.col("toxic") == 1, _share(known, F.col("toxic"), 1)).otherwise(_share(known, F.col("toxic"), 0))
    drawn = F.broadcast(known.filter(unit < taken))  # about the sum of FIT_ROWS at most
    model = train(common.staged(docs.join(drawn, "doc_id"), "learned"), "doc_id", "text", F.col("toxic"))
    out = score(docs, "text", model)
    return out.select("doc_id", (common.id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
