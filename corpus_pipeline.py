"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulframe.llm import decontamination, langid, ngram_join, sentencepieces, substring_dedup
from haulframe.llm.storage import free_name, materialise, small_batches

#: Documents go whose best language has a smaller mean probability. Held-out texts of sf0.1 score 0.40 at least
#: and 0.98 or more in 95 of 100 cases; random letters score 0.33 to 0.88, so the bound rejects few of these:
#: it is set to lose no clean text, texts in two languages included.
LEAST_SCORE = 0.35
#: The near-duplicate stage takes shingles of five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is identified.

    The network learns from the documents' own labels outside the held-out fold. Null texts and texts
    without a letter go, and texts that fit no learned language; if nothing can be learned, all stay.
    """
    small_batches(spark)
    network = langid.train(docs)
    if network is None:
        return docs
    score, pred = free_name("score", docs.columns), free_name("lang_pred", docs.columns)
    found = langid.predict(docs, network)
    return found.where((found[pred] != langid.UNKNOWN) & (found[score] >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates.

    Null texts and texts without words are near duplicates of nothing and stay.
    """
    small_batches(spark)
    return ngram_join.keep_one(docs, k=SHINGLE, percent=PERCENT)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that a smaller doc_id also has.

    A text that loses nothing stays as it is; one that loses words keeps the rest, joined by one
    space, and its n_chars, where documents have that column, is counted anew. Documents of which nothing is left go; those that came without words stay.
    """
    small_batches(spark)
    done = substring_dedup.remove_repeated(docs)
    kept, words, removed = (free_name(n, docs.columns) for n in ("kept_text", "n_words", "n_removed"))
    left = done.where((done[removed] == 0) | (done[removed] < done[words]))
    made = {"text": f"CASE WHEN `{removed}` = 0 THEN `text` ELSE `{kept}` END AS `text`", "n_chars": f"CASE WHEN `{removed}` = 0 THEN `n_chars` ELSE length(`{kept}`) END AS `n_chars`"}
    return left.selectExpr(*(made.get(c.lower(), f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no item of the benchmark; null and empty texts overlap with none and stay."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with piece_ids and lossless (whether decoding the ids gives the text).

    A null text has null ids and a null lossless, an empty text no ids and is lossless.
    """
    small_batches(spark)
    return sentencepieces.round_trip(docs, sentencepieces.Model.load())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what each but the last returns is kept in the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the network or the segmentation.
ORACLE_SQL = None
