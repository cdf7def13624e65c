"""Tokens: vocabulary, ids, truncation, padding, masks, labels."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words, single digits, and any other single character but spaces.
TOKEN_PATTERN = r"\p{L}+|[0-9]|[^\s\p{L}0-9]"

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
IGNORED_LABEL = -100


def text_tokens(text: Column) -> Column:
    """The tokens of a whole text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``(token, n, id)`` for the ``size`` most frequent tokens of the corpus.

    A tokenizer has a vocabulary of fixed size; the counts are combined before
    the shuffle, so frequent tokens do not pile up in one task.
    """
    counts = df.select(F.explode(text_tokens(F.col(text))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    top = counts.orderBy(F.col("n").desc(), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "token"))
    return top.withColumn("id", (rank + (FIRST_ID - 1)).cast("int"))


def tokenize_corpus(df: DataFrame, vocab: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``input_ids``; tokens outside the vocabulary get ``UNKNOWN_ID``.

    The vocabulary has at most ``size`` rows and is handed to the tasks, which
    look ids up a column batch at a time. No shuffle, and a text stays one row.
    """
    rows = vocab.select("token", "id").limit(size + 1).collect()
    if len(rows) > size:
        raise ValueError(f"the vocabulary has more than {size} entries")
    rows.sort(key=lambda r: r["id"])
    shared = df.sparkSession.sparkContext.broadcast(([r["token"] for r in rows], [r["id"] for r in rows]))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def lookup(tokens: pa.Array) -> pa.Array:
        words, ids = shared.value
        flat = tokens.flatten()
        places = pc.index_in(flat, value_set=pa.array(words, flat.type))
        found = pc.fill_null(pc.take(pa.array(ids, pa.int32()), places), UNKNOWN_ID)
        sizes = pc.fill_null(pc.list_value_length(tokens), 0)
        ends = pc.cumulative_sum(sizes.cast(pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, found)

    kept = [c for c in df.columns if c != text]
    tokens = text_tokens(F.coalesce(F.col(text), F.lit("")))
    return df.select(*kept, lookup(tokens).alias("input_ids"))


def tokenize_with(
    df: DataFrame, tokenizer_json: str, max_length: int | None = None, text: str = "text", batch_rows: int = 256
) -> DataFrame:
    """Ids from a ready-made fast tokenizer, given as the JSON text of its file."""
    import tokenizers

    tokenizers.Tokenizer.from_str(tokenizer_json)  # fail here rather than in a task
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = [f.name for f in kept]

    def encode(batches):
        import tokenizers

        tok = tokenizers.Tokenizer.from_str(shared.value)
        if max_length is not None:
            tok.enable_truncation(max_length)
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids = pa.array([e.ids for e in tok.encode_batch(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], ids], [*names, "input_ids"])

    return df.mapInArrow(encode, schema)


def padded_length(max_length: int, multiple: int = 8) -> int:
    return -(-max_length // multiple) * multiple


def truncate_pad(
    df: DataFrame,
    max_length: int,
    multiple: int = 8,
    pad_id: int | None = None,
    eos_id: int = PAD_ID,
    ignore_padding: bool = True,
) -> DataFrame:
    """Ids cut to ``max_length`` and padded, with mask and labels.

    The padded length is a multiple of ``multiple``; without a pad id the
    end-of-text id pads. The mask is 0 on padding; labels are -100 there unless
    ``ignore_padding`` is off, in which case they copy the ids.
    """
    pad = eos_id if pad_id is None else pad_id
    width = padded_length(max_length, multiple)
    ids = F.slice(F.coalesce(F.col("input_ids"), F.array().cast("array<int>")), 1, max_length)
    n = F.col("n_kept")

    def filled(value: int, column: Column) -> Column:
        return F.concat(column, F.array_repeat(F.lit(value), F.lit(width) - n))

    kept = [c for c in df.columns if c not in ("input_ids", "attention_mask", "labels")]
    cut = df.select(*kept, ids.alias("_ids")).withColumn("n_kept", F.size("_ids"))
    labels = filled(IGNORED_LABEL if ignore_padding else pad, F.col("_ids"))
    return cut.select(
        *kept,
        "n_kept",
        filled(pad, F.col("_ids")).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(width) - n)).alias("attention_mask"),
        labels.alias("labels"),
    )


def length_stats(df: DataFrame, max_length: int, by: Sequence[str] = (), multiple: int = 8) -> DataFrame:
    """Lengths, truncated rows and padding that ``truncate_pad`` would cause.

    Needs ``n_tokens``.
    """
    width = padded_length(max_length, multiple)
    n = F.col("n_tokens")
    kept = F.least(n, F.lit(max_length)).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(n.cast("long")).alias("total_tokens"),
        F.max(n).alias("max_tokens"),
        F.count_if(n > max_length).alias("n_truncated"),
        F.sum(n.cast("long") - kept).alias("tokens_cut"),
        F.sum(F.lit(width) - kept).alias("tokens_padding"),
    )
