"""Calls that are made once: a store of answers by request, what is still to be asked, and a log of every failed attempt."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.operators.outputs import parse_and_validate, problems
from mirador.sources.io import append_errors, children, exists, remove
from mirador.sources.model import Backend, Policy, Unsendable, content_of
from mirador.sources.requests import arrow_batches, request_key

FAILURE_TYPE = "struct<attempt:int,model:string,error:string,request_preview:struct<temperature:double,max_tokens:int,message_roles:array<string>>>"
STORE_SCHEMA = f"request_key string, model string, response_text string, attempts int, failures array<{FAILURE_TYPE}>"


def attempted(backend: Backend, messages: str, policy: Policy, model: str, valid: bool = False, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, list[dict]]:
    """(text, posts made, failures): posts until one gives a text, policy.retries times at most. Where only a valid output will do,
    that is a round, and another one follows a text that is none, policy.retries rounds at most; a round's failure has no
    preview of the request. What cannot be sent at all is not tried again."""
    failures: list[dict] = []
    try:
        roles = [m.get("role") for m in json.loads(messages)]
    except (ValueError, TypeError, AttributeError):
        roles = []
    preview = {"temperature": policy.temperature, "max_tokens": policy.max_tokens, "message_roles": roles}
    posts = 0

    def failed(attempt: int, error: str, shown: dict | None) -> None:
        failures.append({"attempt": attempt, "model": model, "error": error, "request_preview": shown})
        if attempt < policy.retries:
            sleep(policy.backoff * 2 ** (attempt - 1))

    for turn in range(1, (policy.retries if valid else 1) + 1):
        text = None
        for attempt in range(1, policy.retries + 1):
            posts += 1
            try:
                text = content_of(backend(messages, policy))
                break
            except Unsendable as e:
                failures.append({"attempt": attempt, "model": model, "error": str(e), "request_preview": preview})
                return None, posts - 1, failures
            except Exception as e:  # noqa: BLE001  any failure of a backend is logged and tried again
                failed(attempt, f"{type(e).__name__}: {e}", preview)
        if text is not None and not valid:
            return text, posts, failures
        broken = problems(text)[1] if text is not None else ["no answer"]
        if valid and not broken:
            return text, posts, failures
        if valid:
            failed(turn, "no valid output: " + "; ".join(broken), None)
    return None, posts, failures


def keyed(requests: DataFrame, policy: Policy, model: str, messages: str = "messages_json") -> DataFrame:
    """requests with their request_key."""
    return requests.withColumn("request_key", request_key(F.col(messages), policy, model))


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """All calls of a store so far. Runs are named one by one: of two scans of one folder in a plan Spark takes the later for the
    earlier, though files came between."""
    runs = [p for p in children(spark, store) if "/run=" in p]
    if not runs:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*runs)


def answers(spark: SparkSession, store: str) -> DataFrame:
    """(request_key, response_text, attempts) of all answered requests of a store, one row a key; empty where there is no store."""
    return _stored(spark, store).where("response_text is not null").groupBy("request_key").agg(F.min("response_text").alias("response_text"), F.min_by("attempts", "response_text").alias("attempts"))


def to_ask(requests: DataFrame, known: DataFrame, messages: str = "messages_json") -> DataFrame:
    """(request_key, messages_json): each different request that has no answer yet, once."""
    once = requests.where(F.col(messages).isNotNull()).select("request_key", F.col(messages).alias("messages_json")).dropDuplicates(["request_key"])
    return once.join(known.select("request_key"), "request_key", "left_anti")


def answered(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests with response_text and attempts; both null where there is no answer."""
    return requests.join(known, "request_key", "left")


def _calls(make_backend: Callable[[], Backend], policy: Policy, model: str, valid: bool, sleep: Callable[[float], None]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for pdf in frames:
            got = [attempted(backend, m, policy, model, valid, sleep) for m in pdf["messages_json"]]
            yield pd.DataFrame({"request_key": pdf["request_key"], "model": model, "response_text": [g[0] for g in got], "attempts": [g[1] for g in got], "failures": [g[2] for g in got]})

    return run


def ask(
    requests: DataFrame, store: str, make_backend: Callable[[], Backend], policy: Policy = Policy(), model: str = "", messages: str = "messages_json",  # noqa: B008
    valid: bool = False, error_log: str | None = None, wave: int = 10_000, batch_rows: int = 64, batch_bytes: int = 16 << 20, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """requests with request_key, response_text and attempts, after posting what the store does not answer.

    Equal requests are posted once. What is to be asked is written down, in waves of about `wave` requests by key; each wave's calls are
    one job that appends its answers, with the failed attempts of each, to the store, from which failures are appended to error_log as
    JSON lines. A run that breaks off leaves the answers of its finished waves; the next run posts only what is not stored (the
    wave that broke off, and requests that never got an answer). Batches handed to Python are bounded by rows and bytes, as
    images make requests large. Null messages are not posted. One run at a time may write to a store."""
    spark = requests.sparkSession
    rows = keyed(requests, policy, model, messages)
    known = answers(spark, store)
    run, waiting = uuid.uuid4().hex, f"{store.rstrip('/')}-waiting-{uuid.uuid4().hex}"
    try:
        left = to_ask(rows, known, messages)
        left.write.parquet(f"{waiting}/all")
        left = spark.read.parquet(f"{waiting}/all")
        waves = -(-left.count() // wave)
        left.withColumn("wave", F.pmod(F.conv(F.substring("request_key", 1, 8), 16, 10).cast("long"), F.lit(max(waves, 1)))).write.partitionBy("wave").parquet(f"{waiting}/waves")
        tasks = spark.sparkContext.defaultParallelism
        for i in range(waves):
            if not exists(spark, f"{waiting}/waves/wave={i}"):
                continue
            part = spark.read.schema("request_key string, messages_json string").parquet(f"{waiting}/waves/wave={i}").repartition(tasks)
            into = f"{store}/run={run}/wave={i}"
            with arrow_batches(spark, batch_rows, batch_bytes):
                part.mapInPandas(_calls(make_backend, policy, model, valid, sleep), STORE_SCHEMA).write.parquet(into)
            if error_log:
                failures = spark.read.schema(STORE_SCHEMA).parquet(into).select(F.explode("failures").alias("f")).select("f.*")
                append_errors(failures, error_log)
    finally:
        remove(spark, waiting)
    return answered(rows, answers(spark, store))


def first_valid(recorded: DataFrame, key: str, text: str, turn: str = "turn", rounds: int = 3) -> DataFrame:
    """(key, rounds, valid, output) from recorded answers (key, turn from 1, text): the round whose text is the first valid output,
    and that output; without one, all rounds and null. Turns beyond `rounds` do not count."""
    said = parse_and_validate(recorded.where(F.col(turn) <= rounds), text, "output")
    ok = F.col("output_status") == "ok"
    best = said.groupBy(key).agg(F.min(F.when(ok, F.col(turn))).alias("first"), F.min_by(F.when(ok, F.col("output")), F.when(ok, F.col(turn))).alias("output"))
    return best.select(key, F.coalesce("first", F.lit(rounds)).cast("int").alias("rounds"), F.col("first").isNotNull().alias("valid"), "output")


def failed_attempts(spark: SparkSession, store: str) -> DataFrame:
    """(request_key, attempt, model, error, request_preview) of all failed attempts that a store knows of."""
    return _stored(spark, store).select("request_key", F.explode("failures").alias("f")).select("request_key", "f.*")
