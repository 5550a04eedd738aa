"""Language identification by word-first backoff.

A known word counts with its log frequency in each language; an unseen one is read from the left in the
longest known character n-grams, down to single characters. The model is fitted on a bounded sample of
labelled rows and so is bounded itself; prediction reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: About so many bytes of text of each language are learned from, drawn by a hash of the id.
FIT_BYTES = 4_000_000
#: But about so many rows at least, also where a language's texts are very long.
FIT_ROWS = 16
#: Words and n-grams seen less often in the sample aren't known.
LEAST_WORD, LEAST_GRAM = 4, 12
LONGEST_GRAM = 5
SEED = 5
UNDETERMINED = "und"
_CACHE = 50_000

_LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters of any script; null: none."""
    return [] if text is None else _LETTERS.findall(text.lower())


@dataclass(frozen=True)
class Model:
    """Log probabilities: a row for each known word and n-gram (word edges are marked by a space), a column for each language."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    floor: np.ndarray


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            counts.update((lang, w) for w in words(text))
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "word", "n"])


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts: Counter[tuple[str, str]] = Counter()
        for lang, word, n in zip(frame["lang"], frame["word"], frame["n"], strict=True):
            w = f" {word} "
            for k in range(1, LONGEST_GRAM + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, w[i : i + k]] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "gram", "n"])


def _logs(rows: list, langs: list[str], by_length: bool) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    at = {x: i for i, x in enumerate(langs)}
    names = sorted({r[1] for r in rows})
    index = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), len(langs)))
    for lang, name, n in rows:
        counts[index[name], at[lang]] = n
    if by_length:  # n-grams of each length add up to 1
        length = np.array([len(x) for x in names], int)
        total = np.ones((int(length.max(initial=0)) + 1, len(langs)))
        np.add.at(total, length, counts)
        total = total[length] if len(names) else np.ones((0, len(langs)))
    else:
        total = counts.sum(0) + 1
    return index, np.log((counts + 0.05) / (total + 0.05 * max(1, len(names)))), np.log(0.05 / (counts.sum(0) + 1))


def train(df: DataFrame, key: str, text: str, lang: str) -> Model:
    """A model from rows with a language; null languages and texts teach nothing. No rows: no languages.

    Rows are drawn by a hash of the key so that about ``FIT_BYTES`` of each language are used,
    or ``FIT_ROWS`` of its rows where that is more: no labelled language is left out.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), (F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003.0)).alias("unit"))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n"))
    sizes = {r.lang: max(FIT_BYTES / max(1, r.b), FIT_ROWS / r.n) for r in sizes.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), np.zeros(0))
    share = F.create_map(*[x for k, part in sizes.items() for x in (F.lit(k), F.lit(min(1.0, part)))])
    drawn = rows.filter(F.col("unit") < share[F.col("lang")]).select("lang", "text")
    counts = drawn.mapInPandas(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = common.staged(counts, "words")
    grams = counts.mapInPandas(_cut, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # known in one language is known: all its counts come along
    known = lambda x, name, least: [tuple(r) for r in x.join(x.groupBy(name).agg(F.sum("n").alias("all")).filter(F.col("all") >= least).select(name), name).select("lang", name, "n").collect()]
    w, wl, _ = _logs(known(counts, "word", LEAST_WORD), langs, False)
    g, gl, floor = _logs(known(common.staged(grams, "grams"), "gram", LEAST_GRAM), langs, True)
    return Model(langs, w, wl.astype(np.float32), g, gl.astype(np.float32), floor)


class Predictor:
    """Scores texts by a model; keeps the rows of unseen words for a while."""

    def __init__(self, model: Model):
        self.model, self.unseen = model, {}

    def backoff(self, word: str) -> np.ndarray:
        """The sum of the log probabilities of the longest known pieces, from the left."""
        m, w, i = self.model, f" {word} ", 0
        found = np.zeros(len(m.langs))
        while i < len(w):
            for k in range(min(LONGEST_GRAM, len(w) - i), 0, -1):
                at = m.grams.get(w[i : i + k])
                if at is not None:
                    found += m.gram_logs[at]
                    break
            else:
                k = 1
                found += m.floor
            i += k
        return found

    def __call__(self, text: str | None) -> tuple[str, float]:
        m = self.model
        counts = Counter(words(text))
        if not counts or not m.langs:
            return UNDETERMINED, 0.0
        total, rows, times = np.zeros(len(m.langs)), [], []
        for w, n in counts.items():
            at = m.words.get(w)
            if at is not None:
                rows.append(at)
                times.append(n)
                continue
            got = self.unseen.get(w)
            if got is None:
                if len(self.unseen) >= _CACHE:
                    self.unseen.clear()
                got = self.unseen[w] = self.backoff(w)
            total += n * got
        if rows:
            total += np.array(times, float) @ m.word_logs[rows]
        # words of a text depend on each other: the evidence counts as the root of their number
        p = total / np.sqrt(sum(counts.values()))
        p = np.exp(p - p.max())
        best = int(p.argmax())
        return m.langs[best], float(p[best] / p.sum())


def predict(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1).

    ``und`` with score 0 if the text is null or has no letter (or nothing was learned). Equal languages
    are told apart by code point order. Input columns named like the added ones give way to them.
    """
    inner, at = common.shielded(df)
    return common.restored(_predict(inner, at[text], model), df.columns, "lang_pred", "score")


def _predict(df: DataFrame, text: str, model: Model) -> DataFrame:
    at = df.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(model)
        for frame in frames:
            got = [predictor(t) for t in frame.iloc[:, at]]
            yield frame.assign(lang_pred=[x[0] for x in got], score=[x[1] for x in got])
        predictor.unseen.clear()
        common.release()

    return df.mapInPandas(predicted, f"{fields}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled ones that aren't held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(common.id_remainder("doc_id", 5) != 0), "doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), "text", model)
    return out.select("doc_id", (common.id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
