"""Embeddings and completions of columns, by pluggable clients.

A runtime is a class with ``models()``, ``embed(model, inputs)`` and, where it can, ``complete(model, prompts,
system)``. Its object is made once in each worker and called with batches. ``hash`` needs no model or
network: it is for tests and as a baseline; ``onnx`` runs a local model file; ``http`` calls a service that
takes a list of inputs and returns a list of vectors.
"""

from __future__ import annotations

import functools
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.arrow import cut
from sextant.functions.vectors import try_cast
from sextant.sources.tables import embeddable

#: Vector of an input that can't be read.
UNREADABLE = -1.0
EMBEDDING, COMPLETION = "embedding_generation", "completion"


class Runtime(Protocol):
    def models(self, job_type: str = EMBEDDING) -> list[tuple[str, int]]: ...
    def embed(self, model: str, inputs: Sequence[str]) -> list[list[float]]: ...


def pool(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Of hidden states (texts, tokens, values): "cls" the first, "mean" of the real ones, "relu_log_max" their largest ln(1 + relu)."""
    if how == "cls":
        return states[:, 0]
    weight = mask[..., None].astype(states.dtype)
    if how == "mean":
        return (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    if how == "relu_log_max":
        return (np.log1p(np.maximum(states, 0)) * weight).max(1)
    raise ValueError(f"unknown pooling: {how}")


class HashRuntime:
    """Unit vectors from hashed words, the same on every machine."""

    def models(self, job_type: str = EMBEDDING) -> list[tuple[str, int]]:
        return [("hash/64", 64), ("hash/256", 256)] if job_type == EMBEDDING else [("hash/echo", 0)]

    def embed(self, model: str, inputs: Sequence[str]) -> list[list[float]]:
        dim = int(model.rsplit("/", 1)[1])
        out = np.zeros((len(inputs), dim))
        for i, text in enumerate(inputs):
            for word in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh64_intdigest(word)
                out[i, h % dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)).astype(np.float32).tolist()

    def complete(self, model: str, prompts: Sequence[str], system: str = "") -> list[str]:
        return [f"{system}{p}" for p in prompts]


class OnnxRuntime:
    """A local encoder; ``files`` maps a model's name to (model file, tokenizer file, pooling, dimension, token limit)."""

    def __init__(self, files: dict[str, tuple[str, str, str, int, int]]):
        self.files, self.loaded = files, {}

    def models(self, job_type: str = EMBEDDING) -> list[tuple[str, int]]:
        return [(k, v[3]) for k, v in self.files.items()] if job_type == EMBEDDING else []

    def embed(self, model: str, inputs: Sequence[str]) -> list[list[float]]:
        if model not in self.loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.files[model][1])
            tokenizer.enable_truncation(self.files[model][4])
            tokenizer.enable_padding()
            self.loaded[model] = onnxruntime.InferenceSession(self.files[model][0]), tokenizer
        session, tokenizer = self.loaded[model]
        codes = tokenizer.encode_batch(list(inputs))
        feed = {"input_ids": np.array([c.ids for c in codes], np.int64), "attention_mask": np.array([c.attention_mask for c in codes], np.int64), "token_type_ids": np.array([c.type_ids for c in codes], np.int64)}
        wanted = {i.name for i in session.get_inputs()}
        states = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
        return pool(states, feed["attention_mask"], self.files[model][2]).astype(np.float32).tolist()


class HttpRuntime:
    """A service with ``/embeddings`` and ``/chat/completions``; models are told by the caller with their dimension."""

    def __init__(self, base_url: str, token: str = "", known: dict[str, int] | None = None, tries: int = 5, wait: float = 4.0, input_type: str = "", dimensions: int | None = None):
        if not re.match(r"https?://[^/]+", base_url):
            raise ValueError(f"not an address: {base_url}")
        self.base_url, self.token, self.known = base_url.rstrip("/"), token, known or {}
        self.tries, self.wait, self.input_type, self.dimensions = tries, wait, input_type, dimensions

    def models(self, job_type: str = EMBEDDING) -> list[tuple[str, int]]:
        return [(k, v) for k, v in self.known.items() if bool(v) == (job_type == EMBEDDING)]

    def _headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.token}"}

    def _post(self, path: str, body: dict) -> dict:
        def once() -> dict:
            request = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json", **self._headers()})
            with urllib.request.urlopen(request, timeout=120) as r:
                return json.load(r)

        return retried(once, self.tries, self.wait)

    def embed(self, model: str, inputs: Sequence[str]) -> list[list[float]]:
        extra = {k: v for k, v in (("input_type", self.input_type), ("dimensions", self.dimensions)) if v}
        return [x["embedding"] for x in self._post("/embeddings", {"model": model, "input": list(inputs), **extra})["data"]]

    def complete(self, model: str, prompts: Sequence[str], system: str = "") -> list[str]:
        head = [{"role": "system", "content": system}] if system else []
        return [self._post("/chat/completions", {"model": model, "messages": [*head, {"role": "user", "content": p}]})["choices"][0]["message"]["content"] for p in prompts]


class OpenAiRuntime(HttpRuntime):
    """The OpenAI form of a service, or Azure's (by its address): inputs are cut to the model's tokens and sent in groups.

    Tokens are counted by ``count`` of a text; without one, three bytes are taken for a token, so that no input is
    too long.
    """

    MODELS = {"openai/text-embedding-ada-002": 1536, "openai/text-embedding-3-small": 1536, "openai/text-embedding-3-large": 3072, "openai/gpt-4o": 0, "openai/gpt-4o-mini": 0}
    MOST_TOKENS, GROUP_TOKENS, GROUP_INPUTS = 8191, 300_000, 2048
    EMBED_PATH, CHAT_PATH = "/embeddings", "/chat/completions"

    def __init__(self, token: str, base_url: str = "https://api.openai.com/v1", count: Callable[[str], int] | None = None, **options):
        super().__init__(base_url, token, dict(self.MODELS), **options)
        self.count, self.usage = count or (lambda x: -(-len(x.encode()) // 3)), 0
        self.azure = ".openai.azure.com" in base_url

    def _headers(self) -> dict[str, str]:
        return {"api-key": self.token} if self.azure else super()._headers()

    def fitting(self, text: str) -> str:
        """The longest start of the text that has no more tokens than the model takes."""
        if self.count(text) <= self.MOST_TOKENS:
            return text
        low, high = 0, len(text)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.count(text[:middle]) <= self.MOST_TOKENS else (low, middle - 1)
        return text[:low]

    def _group(self, model: str, inputs: list[str]) -> list[list[float]]:
        extra = {"dimensions": self.dimensions} if self.dimensions and "3-" in model else {}
        said = self._post(self.EMBED_PATH, {"model": model.split("/", 1)[-1], "input": inputs, **extra})
        self.usage += said.get("usage", {}).get("total_tokens", 0)
        return [x["embedding"] for x in sorted(said["data"], key=lambda x: x.get("index", 0))]

    def embed(self, model: str, inputs: Sequence[str]) -> list[list[float]]:
        texts = [self.fitting(x) for x in inputs]
        out: list[list[float]] = []
        for a, b in greedy_groups([self.count(x) for x in texts], self.GROUP_TOKENS):
            for i in range(a, b, self.GROUP_INPUTS):
                out += self._group(model, texts[i : min(b, i + self.GROUP_INPUTS)])
        return out

    def complete(self, model: str, prompts: Sequence[str], system: str = "") -> list[str]:
        return super().complete(model.split("/", 1)[-1], prompts, system)


class CohereRuntime(OpenAiRuntime):
    """The Cohere form: ``/embed`` with an input type, 96 inputs at a time, and ``/chat``."""

    MODELS = {"cohere/embed-english-v3.0": 1024, "cohere/embed-multilingual-v3.0": 1024, "cohere/embed-english-light-v3.0": 384, "cohere/command-r": 0}
    MOST_TOKENS, GROUP_INPUTS = 512, 96

    def __init__(self, token: str, base_url: str = "https://api.cohere.com/v1", input_type: str = "search_document", **options):
        if input_type not in ("search_document", "search_query", "classification", "clustering"):
            raise ValueError(f"unknown input type: {input_type}")
        super().__init__(token, base_url, input_type=input_type, **options)

    def _group(self, model: str, inputs: list[str]) -> list[list[float]]:
        said = self._post("/embed", {"model": model.split("/", 1)[-1], "texts": inputs, "input_type": self.input_type, "truncate": "END"})
        self.usage += said.get("meta", {}).get("billed_units", {}).get("input_tokens", 0)
        return said["embeddings"]

    def complete(self, model: str, prompts: Sequence[str], system: str = "") -> list[str]:
        return [self._post("/chat", {"model": model.split("/", 1)[-1], "message": p, **({"preamble": system} if system else {})})["text"] for p in prompts]


def retried(call: Callable, tries: int = 5, wait: float = 4.0):
    """The call's result; waits ``wait`` seconds longer after each failure, and raises the last."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(wait * (i + 1))


#: Those but ``hash`` need ``params``: what their class is made with.
_runtimes: dict[str, Callable[..., Runtime]] = {"hash": HashRuntime, "onnx": OnnxRuntime, "http": HttpRuntime, "openai": OpenAiRuntime, "cohere": CohereRuntime}
_BATCH = {"hash": 1000, "onnx": 32, "http": 500, "openai": 500, "cohere": 5000}


def register_runtime(name: str, make: Callable[[], Runtime], batch: int = 100) -> None:
    _runtimes[name], _BATCH[name] = make, batch


def available_runtimes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted(_runtimes)], "runtime string")


def available_models(spark: SparkSession, runtime: str = "hash", job_type: str = EMBEDDING, params: dict | None = None) -> DataFrame:
    return spark.createDataFrame(_made(runtime, params).models(job_type), "model string, dimensions int")


def _maker(runtime: str, params: dict | None) -> Callable[[], Runtime]:
    if runtime not in _runtimes:
        raise ValueError(f"unknown runtime: {runtime}")
    return functools.partial(_runtimes[runtime], **(params or {}))


def _made(runtime: str, params: dict | None = None) -> Runtime:
    return _maker(runtime, params)()


def greedy_groups(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of inputs whose sizes sum to ``most`` at most; a larger one is alone."""
    a = total = 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def llm_embedding(text: Column, model: str = "hash/64", runtime: str = "hash", batch: int | None = None, params: dict | None = None) -> Column:
    """The vector of each text; null of null or blank, all -1 where the runtime can't read the input."""
    make, size = _maker(runtime, params), batch or _BATCH.get(runtime, 100)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            at = [i for i, x in enumerate(s) if x is not None and x.strip()]
            for a in range(0, len(at), size):
                part = at[a : a + size]
                for i, v in zip(part, client.embed(model, [s.iloc[i] for i in part])):
                    out.iloc[i] = v
            yield out

    return run(text)


def text_embedding(text: Column, model: str, files: dict[str, tuple[str, str, str, int, int]], batch: int | None = None) -> Column:
    """Vectors by a local model file: ``files`` as OnnxRuntime takes them."""
    return llm_embedding(text, model, "onnx", batch, {"files": files})


def openai_embedding(text: Column, model: str = "openai/text-embedding-3-small", token: str = "", base_url: str = "https://api.openai.com/v1", dimensions: int | None = None) -> Column:
    return llm_embedding(text, model, "openai", None, {"token": token, "base_url": base_url, "dimensions": dimensions})


def llm_completion(prompt: Column, model: str = "hash/echo", system: str = "", runtime: str = "hash", params: dict | None = None) -> Column:
    """The answer to each prompt; a failure is its text after "Error: "; null of null."""
    make = _maker(runtime, params)

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()

        def one(p):
            if p is None:
                return None
            try:
                return client.complete(model, [p], system)[0]
            except Exception as e:  # noqa: BLE001
                return f"Error: {e}"

        for s in batches:
            yield s.map(one)

    return run(prompt)


def create_embeddings(df: DataFrame, source: str, target: str, model: str = "hash/64", runtime: str = "hash") -> DataFrame:
    """``df`` with ``target`` filled where it was null and the source can be embedded; what is there stays."""
    kept = F.col(target) if target in df.columns else F.lit(None).cast("array<float>")
    fit = F.col(source).isNotNull() & (F.trim(source) != "") & (F.col(source) != "Error: Summary failed (llm)")
    return df.withColumn(target, F.coalesce(kept, llm_embedding(F.when(kept.isNull() & fit, F.col(source)), model, runtime)))


def typed_completions(df: DataFrame, source: str, target: str, kind: str = "string", id: str = "id", **options) -> tuple[DataFrame, DataFrame]:
    """Rows with the completion as ``kind`` in ``target``, and the failures (``row_id, value``): errors and values that don't cast.

    The model is asked once for each row: its answers are written out before they are split.
    """
    done = cut(embeddable(df, source).withColumn("_value", llm_completion(F.col(source), **options)))
    cast = F.when(~F.col("_value").startswith("Error: "), try_cast(F.col("_value"), kind) if kind != "string" else F.col("_value"))
    done = done.withColumn(target, cast)
    return done.where(F.col(target).isNotNull()).drop("_value"), done.where(F.col(target).isNull()).select(F.col(id).alias("row_id"), F.col("_value").alias("value"))


def measure_speed(spark: SparkSession, model: str = "hash/64", runtime: str = "hash", least_seconds: float = 1.5, start: int = 100) -> float:
    """Embeddings a second: the number of texts doubles until a run takes ``least_seconds``."""
    n = start
    while True:
        began = time.perf_counter()
        spark.range(n).select(llm_embedding(F.concat(F.lit("text number "), F.col("id").cast("string")), model, runtime).alias("v")).agg(F.count("v")).first()
        took = time.perf_counter() - began
        if took >= least_seconds or n >= 1 << 24:
            return n / took
        n *= 2
