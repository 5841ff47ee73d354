"""A pipeline over documents: toxic ones go, one of each group of near copies stays, repeated passages and documents with
benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of ``documents``.

Defined cases, for every stage: null and empty texts are texts without words (they are not toxic, near copies of each other, lose
nothing, hold no item and have no ids); long texts are read whole; an empty table gives an empty table; further columns stay,
whatever their names. Rows that repeat an id are kept by all stages but the second, for which they are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.llm import common, sentencepiece_stream, simhash, toxicity
from pitframe.llm.decontaminate import with_matches
from pitframe.llm.queries import tokenizer_path
from pitframe.llm.substrings import remove_repeated_words


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    score, predicted = _free(docs, "_score"), _free(docs, "_predicted")
    return toxicity.score(docs, model, score_col=score, predicted_col=predicted).filter(F.col(predicted) == 0).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each SimHash component; of rows that repeat that id the one with the least digest of its text.

    Rows without id all stay: they have no document that could stand for them.
    """
    found = simhash.near_duplicates(docs)
    kept = common.cut(found.filter("doc_id = component").groupBy("doc_id").agg(F.count("*").alias("n")))
    out = docs.join(kept.filter("n = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null"))
    if not kept.filter("n > 1").isEmpty():
        again = docs.join(kept.filter("n > 1").select("doc_id"), "doc_id", "left_semi")
        row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
        one = again.groupBy("doc_id").agg(F.min_by(row, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("row"))
        out = out.unionByName(one.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))))
    return out


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under repeated windows; ``n_chars`` counts what is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    out = remove_repeated_words(plain, text=True, carry=tuple(f"c{i}" for i in range(len(others))))
    out = out.select("doc_id", F.col("kept_text").alias("text"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(others)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    to = _free(docs, "_matches")
    return with_matches(docs, common.table(spark, sf_dir, "benchmark"), to=to).filter(F.size(to) == 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, and whether decoding gives the text back; columns of these names are replaced."""
    to = _free(docs, "_encoded")
    own = [c for c in docs.columns if c not in ("piece_ids", "n_pieces", "exact")]
    out = sentencepiece_stream.encode_checked(docs, tokenizer_path("piece_bpe_32k.model"), to=to)
    return out.select(*own, F.col(f"{to}.ids").alias("piece_ids"), F.size(f"{to}.ids").alias("n_pieces"), F.col(f"{to}.exact").alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
