"""Model calls as partition-wise functions over an injected backend, with retry, status and no secrets in plans."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from mirador.operators.outputs import PARSED_TYPE, problems


@dataclass(frozen=True)
class Policy:
    """temperature, tokens, and retries; after failure i (from 0) the wait is backoff * 2**i seconds, none after the last."""

    temperature: float = 0.2
    max_tokens: int = 800
    retries: int = 3
    backoff: float = 2.0
    timeout: float = 120.0


class Unsendable(ValueError):
    """A request that must not be sent as it is; trying again does not help."""


#: A backend: (messages as JSON text, policy) -> response document.
Backend = Callable[[str, Policy], dict]


def content_of(response: dict) -> str:
    """The text of a chat response; parts of a list are joined by newlines, empty ones left out."""
    choices = response.get("choices") or []
    if not choices:
        raise ValueError("no choices in the response")
    content = (choices[0].get("message") or {}).get("content")
    if isinstance(content, list):
        content = "\n".join(t for p in content if (t := p.get("text")))
    if not content:
        raise ValueError("empty content")
    return content


def complete(backend: Backend, messages: str, policy: Policy, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """(text, attempts, last error)."""
    error = None
    for attempt in range(policy.retries):
        try:
            return content_of(backend(messages, policy)), attempt + 1, None
        except Unsendable as e:
            return None, attempt, str(e)
        except Exception as e:  # noqa: BLE001  any failure of a backend is retried and reported
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < policy.retries:
                sleep(policy.backoff * 2**attempt)
    return None, policy.retries, error


def refuse_local(messages: list[dict]) -> None:
    """An error for messages with an image's local address: the service could not read it, and paths stay here."""
    for m in messages:
        for part in m["content"] if isinstance(m.get("content"), list) else []:
            address = (part.get("image_url") or {}).get("url") if isinstance(part, dict) else None
            if part.get("type") == "image_url" and not str(address).lower().startswith(("data:", "http:", "https:")):
                raise Unsendable(f"an image of the request has no address that can be sent: {address}")


def http_backend(url: str, model: str, key_variable: str | None = None) -> Callable[[], Backend]:
    """For call_model: a backend that posts to a chat completion service. The key is read on the executor, from the environment
    variable named, when the backend is made; an absent one is an error then. Images must be attached as data, or be on the web."""

    def make() -> Backend:
        headers = {"Content-Type": "application/json"}
        if key_variable:
            if not os.environ.get(key_variable):
                raise RuntimeError(f"the environment variable {key_variable} is not set")
            headers["Authorization"] = f"Bearer {os.environ[key_variable]}"

        def post(messages: str, policy: Policy) -> dict:
            said = json.loads(messages)
            refuse_local(said)
            body = {"model": model, "messages": said, "temperature": policy.temperature, "max_tokens": policy.max_tokens, "response_format": {"type": "text"}}
            request = urllib.request.Request(url, json.dumps(body).encode(), headers)
            with urllib.request.urlopen(request, timeout=policy.timeout) as response:  # raises for a status that is no success
                return json.loads(response.read())

        return post

    return make


def complete_output(backend: Backend, messages: str, policy: Policy, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, int, str | None]:
    """(parsed output, rounds, last error): complete() until its text parses to a valid output, policy.retries times at most."""
    error = None
    for turn in range(policy.retries):
        text, _, error = complete(backend, messages, policy, sleep)
        if text is not None:
            parsed, broken = problems(text)
            if not broken:
                return parsed, turn + 1, None
            error = "; ".join(broken)
        if turn + 1 < policy.retries:
            sleep(policy.backoff * 2**turn)
    return None, policy.retries, error


def call_for_output(df: DataFrame, make_backend: Callable[[], Backend], policy: Policy = Policy(), messages: str = "messages_json", into: str = "output", sleep: Callable[[float], None] = time.sleep) -> DataFrame:  # noqa: B008
    """df with `into` (the parsed struct, null where no round gave a valid output), `into`_rounds and `into`_error: a call, its
    parsing and validation, and another round after an invalid one. As with call_model, write the result before
    reading it twice."""
    out = df.selectExpr("*", f"CAST(NULL AS {PARSED_TYPE}) AS {into}", f"0 AS {into}_rounds", f"CAST(NULL AS string) AS {into}_error").schema
    for f in out:
        f.nullable = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for pdf in frames:
            got = [complete_output(backend, m, policy, sleep) for m in pdf[messages]]
            yield pdf.assign(**{into: [x[0] for x in got], f"{into}_rounds": [x[1] for x in got], f"{into}_error": [x[2] for x in got]})

    return df.mapInPandas(run, out)


def call_model(df: DataFrame, make_backend: Callable[[], Backend], policy: Policy = Policy(), messages: str = "messages_json") -> DataFrame:  # noqa: B008
    """df with response_text, attempts, call_error. make_backend runs once a partition, on the executor, and reads secrets there.

    Write the result before reading it twice: each evaluation calls the model again."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for pdf in frames:
            got = [complete(backend, m, policy) for m in pdf[messages]]
            yield pdf.assign(response_text=[x[0] for x in got], attempts=[x[1] for x in got], call_error=[x[2] for x in got])

    return df.mapInPandas(run, f"{kinds}, response_text string, attempts int, call_error string")
