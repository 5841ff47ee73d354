"""Token counts behind a digest cache (operator 6).

``token_counts`` joins a digest of the normalised content and a digest of the tokenizer file to stored counts, encodes
one text for each digest that is not stored, appends the new counts to the cache and joins them back to the rows. The cache is
a table partitioned by the tokenizer's digest, so that another version's counts are not even read. Only ids and digests move
until it is known what is missing: with nothing missing no text is read again, with up to ``FEW`` missing digests these go to the texts
by broadcast (some 100 bytes each), and only beyond that the missing texts are shuffled. Rows of frequent contents are dealt
over all tasks when they get their counts.

Defined cases: a null text counts as empty; a row with a null id is counted like any other; an empty text has no tokens; repeated texts and repeated rows are encoded
once and each row gets its count; an empty table gives an empty result; columns of the input other than the id and the
text are not carried. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CACHE = "content_digest string, n_tokens long, tokenizer_digest string"
#: Missing digests that are broadcast, some 50 MB; more of them are joined by a shuffle of the missing texts.
FEW = 500_000
#: Distinct words that a worker remembers between texts; beyond that it forgets all and starts again.
WORDS = 300_000

_counters: dict[str, Counter] = {}


class Counter:
    """Counts tokens of whole texts with one tokenizer file, remembering the counts of white-space separated words.

    Only for tokenizers whose pre-tokenizer drops white space are a text's tokens those of its words put together
    (``by_word``); for others each text goes to the library whole.
    """

    def __init__(self, path: str, by_word: bool):
        self.by_word, self.known = by_word, {}
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.lengths = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.lengths(texts)
        out = []
        for text in texts:
            words = text.encode().split()
            if len(self.known) > WORDS:
                self.known.clear()
            if new := list(set(words).difference(self.known)):
                self.known.update(zip(new, self.lengths([w.decode() for w in new]), strict=True))
            out.append(sum(map(self.known.__getitem__, words)))
        return out


def _counter(path: str, by_word: bool) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _counters:
        _counters[path] = Counter(path, by_word)
    return _counters[path]


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str, *, limit: int, by_word: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; the counts of texts not seen before are appended to ``cache``.

    ``tokenizer`` is a file for the tokenizers library (.json) or for sentencepiece (.model). With ``by_word`` runs of
    ASCII white space are one space in the normalised content, as the tokenizer drops white space.
    """
    spark = common.session(docs)
    version = tokenizer_digest(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    content = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ") if by_word else F.col("text")
    keyed = common.cut(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(content, 256).alias("content_digest")))
    stored = _stored(spark, cache, version)
    # one row for each digest not stored: the smallest id stands for it
    counted = keyed.groupBy("content_digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    missing = common.cut(counted.join(stored, "content_digest", "left_anti").select("content_digest", "first_id"))
    if n_missing := missing.count():
        few = F.broadcast(missing) if n_missing <= FEW else missing
        # id and digest together: ids may repeat with different texts, and may be null
        texts = rows.withColumn("d", F.sha2(content, 256)).join(few, (F.col("d") == F.col("content_digest")) & F.col("id").eqNullSafe(F.col("first_id"))).select("content_digest", "text")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = _counter(tokenizer, by_word)
            for batch in batches:
                n = counter.count(batch.column("text").to_pylist())
                yield pa.record_batch([batch.column("content_digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

        fresh = texts.mapInArrow(encode, "content_digest string, n_tokens long").groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
        fresh.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    counts = _stored(spark, cache, version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
    out = common.join_unique(keyed, counts, "content_digest", common.frequent(counted, "content_digest", "n"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark, cache: str, version: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
