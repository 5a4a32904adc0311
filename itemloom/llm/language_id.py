"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) pairs and documents of each language over all labelled rows, summed by Spark; the
log-probability matrix, of n_buckets rows and a column for each language, and the languages' priors are broadcast, and
texts are scored in numpy by gathering the matrix's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import crc32, held, mix, text_blocks

ORDERS = (1, 2, 3)
N_BUCKETS = 1 << 15
ALPHA = 0.5
UNKNOWN = "und"
#: Text bytes turned into code points at once.
LID_BLOCK = 1 << 19


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: the letter that stands for it in n-grams (lower case; a blank for what is no letter), and whether it is a letter."""
    letter, fold = np.zeros(0x110000, bool), np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            letter[c], fold[c] = True, ord(low) if len(low) == 1 else c
    return fold, letter


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (bucket of each n-gram, its row's first n-gram with one more at the end, whether each row has a letter)."""
    fold, letter = held("letters", _tables)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    first = heads[offsets]
    has = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter[points], out=has[1:])
    letters = has[first[1:]] > has[first[:-1]]
    chars = fold[points].astype(np.uint64)
    for n in ORDERS:
        count = np.maximum(np.diff(first) - (n - 1), 0)
        at = np.zeros(len(first), np.int64)
        np.cumsum(count, out=at[1:])
        if n > 1 and at[-1]:
            key = chars[: len(chars) - n + 1].copy()
            for j in range(1, n):
                key = (key << np.uint64(21)) | chars[j : len(chars) - n + 1 + j]
            inside = np.zeros(len(key) + 1, np.int8)  # n-grams that do not cross into the next row
            np.add.at(inside, first[:-1][count > 0], 1)
            np.add.at(inside, (first[:-1] + count)[count > 0], -1)
            key = key[np.cumsum(inside[:-1]) > 0]
        else:
            key = chars if at[-1] else chars[:0]
        yield (mix(key + np.uint64(n << 60)) >> np.uint64(40)).astype(np.int64) & (n_buckets - 1), at, letters


def _count(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=LID_BLOCK):
            langs = rows.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.searchsorted(names, langs)
            for name, n in zip(names, np.bincount(of, minlength=len(names)).tolist(), strict=True):
                docs[name] = docs.get(name, 0) + n
            for bucket, at, _ in ngram_buckets(data, offsets, n_buckets):
                both = np.bincount(np.repeat(of, np.diff(at)) * n_buckets + bucket, minlength=len(names) * n_buckets)
                for i, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + both[i * n_buckets : (i + 1) * n_buckets]
    for name, n in counts.items():
        at = np.flatnonzero(n)
        bucket, n = np.append(at, -1), np.append(n[at], docs[name])  # bucket -1: documents
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(bucket), pa.string()), "bucket": bucket.astype(np.int32), "n": n})


class Model:
    """langs: sorted labels. logp: float32 matrix (bucket, language). prior: log share of each language in the documents learned from."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.langs, self.logp, self.prior = langs, logp, prior


def train(labelled: DataFrame, n_buckets: int = N_BUCKETS, alpha: float = ALPHA) -> Model:
    """Naive Bayes from the columns text and lang. Rows with a null text or lang teach nothing; a repeated row counts
    again; without labelled rows the model has no language and predicts `und`. The driver gets at most n_buckets sums
    for each language, whatever the number of rows."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(lambda it: _count(it, n_buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()
    langs = sorted(table["lang"].unique())
    n = np.zeros((n_buckets + 1, len(langs)))
    n[table["bucket"].to_numpy(), np.searchsorted(langs, table["lang"].to_numpy().astype(str)) if langs else []] = table["n"].to_numpy()
    n, docs = n[:-1], n[-1]
    return Model(langs, np.log((n + alpha) / (n.sum(axis=0) + alpha * n_buckets)).astype(np.float32), np.log(docs / docs.sum()))


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    n_langs = len(model.langs)
    names = np.array([*model.langs, UNKNOWN], object)
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, limit=LID_BLOCK):
            n = rows.num_rows
            total, letters = np.zeros((n, max(n_langs, 1))), np.zeros(n, bool)
            for bucket, at, letters in ngram_buckets(data, offsets, len(model.logp)):  # noqa: B007
                full = np.flatnonzero(np.diff(at))
                if n_langs and len(full):
                    total[full] += np.add.reduceat(model.logp[bucket], at[full], axis=0, dtype=np.float64)
            if n_langs:
                total += model.prior
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
            known = letters & (n_langs > 0) & rows.column("text").is_valid().to_numpy(zero_copy_only=False)
            out = rows.drop_columns("text")
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(names[np.where(known, best, n_langs)], pa.string()), pa.array(np.where(known, score, 0.0))], [*out.schema.names, "lang_pred", "lang_score"]
            )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns doc_id and whatever else docs has but text, with lang_pred and lang_score (posterior share, 0 to 1).

    `und` with score 0 where text is null, empty or has no letter, or where the model has no language. Equal scores go to
    the language first in order. Texts of any length are scored whole, repeated rows each. Columns of docs that are named
    lang_pred or lang_score are replaced. An empty table gives an empty table."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([f for f in docs.schema.fields if f.name != "text"]).add("lang_pred", StringType()).add("lang_score", DoubleType())
    return docs.mapInArrow(lambda it: _predict(it, shared), schema)


def split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to learn from, all with held_out): a quarter is held out by the crc32 of doc_id."""
    held = F.coalesce(F.expr(f"{crc32('doc_id')} % 4 = 2"), F.lit(False))
    return docs.where(~held), docs.withColumn("held_out", held)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learn, every = split(docs)
    out = predict(every.select("doc_id", "held_out", "text"), train(learn))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
