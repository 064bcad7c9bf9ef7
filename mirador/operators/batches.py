"""Training batches: chat texts as token ids, cut at the configured length, grouped by length, padded on the right, and labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions.arrays import label_mask
from mirador.functions.tokens import token_ids
from mirador.operators.prompts import chat_text


def sft_tokens(rows: DataFrame, tokenizer: str, max_length: int = 1536, messages: str = "messages") -> DataFrame:
    """rows with input_ids, the ids of the whole chat, and prompt_tokens, the number of those of all but its last message with the
    opening of a reply; both are cut at max_length. Write the result before reading it twice."""
    said = F.col(messages)
    prompt = chat_text(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), reply=True)
    asked = F.size(token_ids(prompt, tokenizer, max_length))
    return rows.withColumns({"input_ids": token_ids(chat_text(said), tokenizer, max_length), "prompt_tokens": asked})


def preference_tokens(rows: DataFrame, tokenizer: str, prompt: Column, completion: Column) -> DataFrame:
    """rows with input_ids of a prompt and its completion, not cut, and prompt_tokens, the number of the prompt's own ids."""
    return rows.withColumns({"input_ids": token_ids(F.concat(prompt, completion), tokenizer), "prompt_tokens": F.size(token_ids(prompt, tokenizer))})


def length_batches(rows: DataFrame, key: str, batch_size: int, pad_id: int, step: int = 64, shard_rows: int = 4096) -> DataFrame:
    """(bucket, shard, batch, keys, input_ids, attention_mask, labels, prompt_lengths): batches of up to batch_size rows of input_ids and
    prompt_tokens, as lists of rows of equal length.

    A bucket holds rows whose length rounds up to the same multiple of step. A bucket of many rows is dealt, by md5 of the key, into
    shards of about shard_rows; a shard's rows, by length, key and ids, are cut into batches, each padded to its own longest row.
    So no task sorts more than a shard, though all rows were of one length. Labels are -100 for the prompt and for pads.
    rows are read twice (counted by bucket first): give a written table. Rows without ids are in bucket 0."""
    sized = rows.select(F.col(key).cast("string").alias("key"), "input_ids", "prompt_tokens", F.size("input_ids").alias("length")).withColumn("bucket", F.ceil(F.col("length") / step).cast("int"))
    counts = {r["bucket"]: r["count"] for r in sized.groupBy("bucket").count().collect()}  # a row for each step up to the longest
    shards = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(-n // shard_rows))]) if counts else F.create_map().cast("map<int,int>")
    dealt = sized.withColumn("shard", F.pmod(F.conv(F.substring(F.md5(F.coalesce("key", F.lit(""))), 1, 8), 16, 10).cast("long"), F.try_element_at(shards, "bucket")).cast("int"))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("length", "key", "input_ids")) - 1
    groups = dealt.withColumn("n", nth).groupBy("bucket", "shard", F.floor(F.col("n") / batch_size).cast("int").alias("batch"))
    whole = groups.agg(F.array_sort(F.collect_list(F.struct("n", "key", "length", "input_ids", "prompt_tokens"))).alias("all"), F.max("length").alias("longest"))
    each = lambda f: F.transform("all", f)
    left = lambda r: F.col("longest") - r["length"]
    padded = lambda r: F.concat(r["input_ids"], F.array_repeat(F.lit(pad_id), left(r)))
    return whole.select(
        "bucket", "shard", "batch", each(lambda r: r["key"]).alias("keys"), each(padded).alias("input_ids"),
        each(lambda r: F.concat(F.array_repeat(F.lit(1), r["length"]), F.array_repeat(F.lit(0), left(r)))).alias("attention_mask"),
        each(lambda r: label_mask(padded(r), r["prompt_tokens"], F.lit(pad_id))).alias("labels"), each(lambda r: r["prompt_tokens"]).alias("prompt_lengths"),
    )
