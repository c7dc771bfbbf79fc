"""Exact token totals per slice of a corpus (problem 3)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import lookup
from millrace.workspace import materialise

#: Folder of public vocabularies; every executor must have it. A parameter everywhere below.
TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern of the 50k byte-level vocabulary. Fixed value.
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(vocabulary: str, presplit: str = PRESPLIT):
    """The tokenizer of a rank file, loaded once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("ranks", pat_str=presplit, mergeable_ranks=ranks, special_tokens={}), ranks


def pieces(text: Column, presplit: str = PRESPLIT) -> Column:
    """The pieces that the tokenizer encodes one by one; joined they are the text. The vocabulary has no normalisation step.

    The JVM may know fewer characters than the tokenizer: a text with one that it takes for unassigned is a single piece,
    which the tokenizer then splits itself.
    """
    own = F.regexp_extract_all(text, F.lit("(?U)" + presplit), F.lit(0))
    return F.when(F.rlike(text, F.lit(r"\p{Cn}")), F.array(text)).otherwise(own)


def _lengths(vocabulary: str, presplit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ranks = encoding(vocabulary, presplit)
        for b in batches:
            words = b.column(0).to_pylist()
            n = [1 if w.encode() in ranks else len(enc.encode_ordinary(w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["piece", "piece_tokens"])

    return run


def token_totals(documents: DataFrame, slice_columns: dict[str, Column], text: str = "text", vocabulary: str = VOCABULARY, presplit: str = PRESPLIT) -> DataFrame:
    """Documents and tokens of every slice, exact: columns of ``slice_columns``, ``documents``, ``tokens``.

    The texts are cut by the tokenizer's own pattern inside the JVM, pieces are counted per slice (combined before the
    shuffle, so that neither a frequent piece nor a large slice is one task's work), each distinct piece is encoded once, and
    its length is joined with the counts. Null slice values form a slice of their own; null and empty texts count as documents
    without tokens; repeated rows count as often as they come; an empty table has no slices. Other columns are not touched.
    """
    names = list(slice_columns)
    rows = documents.select(F.col(text).alias("__text"), *[c.alias(n) for n, c in slice_columns.items()])
    rows = rows.withColumn("__slice", F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("")) for n in names]))
    counts = rows.select("__slice", F.explode(pieces(F.col("__text"), presplit)).alias("piece")).groupBy("piece", "__slice").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "pieces")  # read twice below; the texts once
    lengths = counts.select("piece").distinct().mapInArrow(_lengths(vocabulary, presplit), "piece string, piece_tokens bigint")
    totals = counts.join(lengths, "piece").groupBy("__slice").agg(F.sum(F.col("n") * F.col("piece_tokens")).alias("tokens"))
    slices = rows.groupBy("__slice", *names).agg(F.count(F.lit(1)).alias("documents"))
    return slices.join(totals, "__slice", "left").select(*names, "documents", F.coalesce("tokens", F.lit(0).cast("bigint")).alias("tokens"))


def document_tokens(documents: DataFrame, key: Column, text: str = "text", vocabulary: str = VOCABULARY, presplit: str = PRESPLIT) -> DataFrame:
    """``record_key, tokens``: the exact number of tokens of every document.

    A piece that is an entry of the vocabulary is one token; the vocabulary, of a fixed size, is broadcast, and such pieces are
    only counted. For all other pieces the document's frequencies are joined with lengths, each distinct piece being encoded
    once. Rows of one key are added up; a null key is a key; null and empty texts have 0 tokens.
    """
    spark = documents.sparkSession
    own: list[tuple[str]] = []
    for b in encoding(vocabulary, presplit)[1]:
        try:
            own.append((b.decode(),))
        except UnicodeDecodeError:  # a part of a character is never a piece
            continue
    known = spark.createDataFrame(own, "piece string").withColumn("known", F.lit(True))
    rows = documents.select(key.alias("record_key"), F.explode_outer(pieces(F.col(text), presplit)).alias("piece"))
    rest = rows.join(F.broadcast(known), "piece", "left").select("record_key", F.when(F.col("known").isNull(), F.col("piece")).alias("piece"), F.when(F.col("piece").isNotNull(), 1).otherwise(0).alias("one"))
    freq = materialise(rest.groupBy("record_key", "piece").agg(F.sum("one").alias("n")), "frequencies")
    others = freq.where("piece is not null")
    lengths = others.select("piece").distinct().mapInArrow(_lengths(vocabulary, presplit), "piece string, piece_tokens bigint")
    counted = lookup(others, lengths, "piece", "inner").groupBy("record_key").agg(F.sum(F.col("n") * F.col("piece_tokens")).alias("t"))
    plain = freq.where("piece is null").select("record_key", F.col("n").alias("t"))
    return plain.unionByName(counted).groupBy("record_key").agg(F.sum("t").alias("tokens"))


def budget_cover(totals: DataFrame, config: DataFrame, source: str = "source") -> DataFrame:
    """Tokens at hand for every source of every recipe against its budget: ``config_id, source_key, budget_tokens, tokens, cover, epochs_needed``."""
    have = totals.groupBy(F.col(source).alias("source_key")).agg(F.sum("tokens").alias("tokens"))
    c = config.select("config_id", "source_key", "budget_tokens").join(have, "source_key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    return c.select("config_id", "source_key", "budget_tokens", "tokens", F.try_divide(F.col("tokens").cast("double"), F.col("budget_tokens")).alias("cover"), F.try_divide(F.col("budget_tokens").cast("double"), F.col("tokens")).alias("epochs_needed"))
