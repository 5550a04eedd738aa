"""A corpus pipeline: each stage is one operator over all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmend.llm import common, decontam, langid, mixing, neardup, sharding

#: Near duplicates share so many hundredths of their shingles or more.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, a null ``lang`` filled in by the prediction; documents without any letter (or text) go.

    The model is learned from the labelled documents among ``docs`` that aren't held out. Where none teaches
    a language (all null, an empty table), all documents with a letter stay as they are. Rows keep to
    themselves: null and repeated ids, equal rows and very long texts are no matter. A ``lang`` that isn't
    null stays as it is.
    """
    model = langid.train(docs.filter(common.id_remainder("doc_id", 5) != 0), "doc_id", "text", "lang")
    inner, at = common.shielded(docs)  # columns of any name stay
    if not model.langs:
        return common.restored(inner.filter(F.col(at["text"]).rlike(r"\p{L}")), docs.columns)
    told = langid.predict(inner, at["text"], model).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return common.restored(told.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")), docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` shielded, with a distinct ``row`` number for each row, and the columns' new names.

    The number is the id where ids are distinct and none is null; else it goes by id, nulls first, and then
    by a hash of the text.
    """
    inner, at = common.shielded(docs)
    key, body = F.col(at["doc_id"]).cast("bigint"), F.coalesce(F.col(at["text"]), F.lit(""))
    n = inner.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n[0] == n[1]:
        return inner.withColumn("row", key), at
    keyed = inner.withColumns({"key_id": F.coalesce(key, F.lit(-(1 << 63))), "key_text": common.hash60(body), "key_size": (F.octet_length(body) + 16).cast("bigint")})
    placed = sharding.assign(keyed, "key_id", "key_text", "key_size", 1, "rows")
    return common.staged(placed.select(*inner.columns, F.col("slot").alias("row")), "numbered"), at  # fixes the numbers


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least id, a null id first; of one id, any.

    Rows count, not ids: rows of one id or with a null id are documents of their own. Null and empty texts
    have no duplicates and stay. A text of under five words is a duplicate of equal words alone.
    """
    inner, at = _numbered(docs)
    found = neardup.near_duplicates(inner, "row", at["text"], NEAR_PERCENT).filter("kept").select(F.col("id").alias("kept_row"))
    return common.restored(inner.join(found, F.col("row") == F.col("kept_row"), "left_semi"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words are benchmark words.

    Each row is judged by its own words: null and repeated ids are no matter. Null and empty texts, and all
    rows where the benchmark is empty, stay.
    """
    inner, at = _numbered(docs)
    index = decontam.build_index(inner, "row", at["text"])
    found = decontam.contamination(index, decontam.search(index, common.table(spark, sf_dir, "benchmark"), "item_id", "text"))
    bad = found.filter((F.col("n_hit") > 0) & (decontam.ONE_IN * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc").alias("bad_row"))
    return common.restored(inner.join(bad, F.col("row") == F.col("bad_row"), "left_anti"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (:func:`quillmend.llm.mixing.mix`).

    A null source is one of its own, null and empty texts have size 0 and follow their place in their
    source's order, as do rows of one id.
    """
    inner, at = common.shielded(docs)
    taken = mixing.mix(inner.withColumn("mix_size", mixing.word_count(at["text"])), at["source"], "mix_size", at["doc_id"])
    taken = taken.filter("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return common.restored(taken, docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their ``shard`` and their ``slot`` in it; equal texts, nulls and empty ones among them, side by side."""
    inner, at = common.shielded(docs)
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    keyed = inner.withColumns({"key_text": common.hash60(text), "key_id": common.hash60(F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit(""))), "key_size": (F.octet_length(text) + 16).cast("bigint")})
    return common.restored(sharding.assign(keyed, "key_text", "key_id", "key_size", sharding.SHARDS), docs.columns, "shard", "slot")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with common.scope(spark) as made:  # what a stage stages inside goes when its result is written
            made += before
            docs, path = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
            made.remove(path)
        before = [path]
    for path in before:
        common.at_exit(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model is fitted by counts and hashes that SQL can't express in a bearable form; the tests
#: hold every stage against brute force instead.
ORACLE_SQL = None
