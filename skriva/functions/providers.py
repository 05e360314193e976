"""Plug-in points: embedders, rerankers, vector stores and language-model clients, as protocols with deterministic providers for tests and offline runs.

Providers run inside Arrow-batched UDFs on the executors, so a provider must be picklable; remote ones open their connection when first used."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import text as T
from . import vectors as V


class Embedder(Protocol):
    """UDF1."""

    model_name: str
    dimension: int

    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """UDF2."""

    model_name: str

    def score(self, query: str, passages: list[str]) -> list[float]: ...


class LLMClient(Protocol):
    """UDF4."""

    model_name: str

    def generate(self, prompt: str) -> str: ...


# The concepts of the offline embedder, each a dimension.
CONCEPTS = [
    ["car", "automobile", "vehicle", "semantic", "meaning", "dense", "语义", "向量"], ["bm25", "lexical", "term", "keyword", "关键词", "倒数"], ["fusion", "fuse", "combined", "combines", "rrf", "reciprocal", "合并", "融合"],
    ["recall", "rank", "quality", "coverage", "noise", "召回", "覆盖", "噪声", "质量", "指标"], ["latency", "p50", "p95", "percentile", "延迟", "分位"], ["section", "chapter", "constraint", "filter", "章节"],
    ["reranker", "rerank", "cross", "encoder", "database", "基线"],
]


def _alone(word: str) -> str:
    """A pattern of a word; ASCII words count where they stand alone. The word comes first and what precedes it is looked at behind it, so that most places of a text
    are passed by their first letter."""
    w = re.escape(word)
    return rf"{w}(?<![a-z0-9_]{w})(?![a-z0-9_])" if word.isascii() else w


class ConceptEmbedder:
    """SC7: how often the words of each concept occur; ASCII words count where they stand alone."""

    model_name = "concepts"

    def __init__(self, concepts: list[list[str]] = CONCEPTS):
        self.concepts, self.dimension = concepts, len(concepts)

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        order = lambda w: len(re.escape(w)) + (26 if w.isascii() else 0)
        patterns = [re.compile("|".join(map(_alone, sorted(ws, key=order, reverse=True)))) for ws in self.concepts]
        return [[float(len(p.findall(t))) for p in patterns] for t in map(str.lower, texts)]


def concept_vector(c, concepts: list[list[str]] = CONCEPTS):
    """SC7 as an expression: one count per word, so that words inside other ones of a concept count each."""
    low = F.lower(F.coalesce(c, F.lit("")))
    count = lambda w: F.regexp_count(low, F.lit(_alone(w)))
    return F.array(*[sum((count(w) for w in ws[1:]), count(ws[0])).cast("double") for ws in concepts])


class BrokenProvider:
    """UDF7: an embedder and reranker that is never there."""

    model_name, dimension = "broken", 1

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        raise ConnectionError("provider is unavailable")

    def score(self, query: str, passages: list[str]) -> list[float]:
        raise ConnectionError("provider is unavailable")


def embed(df: DataFrame, column: str, provider: Embedder, out: str = "embedding", batch: int = 64) -> DataFrame:
    """UDF1, UDF6: df with the vector of each text. Every distinct text is embedded once: providers are the dear part, the join back is not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                vectors = provider.embed_texts(part["t"].tolist())
                if len(vectors) != len(part) or any(len(v) != provider.dimension or not all(map(math.isfinite, v)) for v in vectors):
                    raise ValueError("the embedder's answer does not fit its question")
                yield pd.DataFrame({"h": part["h"], "v": vectors})

    key = F.sha2(F.col(column), 256)
    once = df.where(F.col(column).isNotNull()).groupBy(key.alias("h")).agg(F.first(column).alias("t"))
    found = once.mapInPandas(run, "h string, v array<double>").withColumnRenamed("v", out)
    return df.withColumn("__h", key).join(found.withColumnRenamed("h", "__h"), "__h", "left").drop("__h")


class OverlapReranker:
    """The share of the query's words that a passage holds."""

    model_name = "overlap"

    def score(self, query: str, passages: list[str]) -> list[float]:
        tokens = lambda s: set(re.findall(T.EVAL_TOKEN, s.casefold()))
        q = tokens(query)
        return [len(q & tokens(p)) / max(1, len(q)) for p in passages]


def rerank(candidates: DataFrame, provider: Reranker, fallback: bool = True) -> DataFrame:
    """UDF2: candidates (query_id, query, chunk_id, text, score, rank) with rerank_score, base_rank, the new rank and degraded_reason. A query's candidates
    are few (the retrieval's depth). A failing provider leaves the base order and says so, unless ``fallback`` is off."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        reason = None
        try:
            scores = provider.score(g["query"].iloc[0], g["text"].tolist())
            if len(scores) != len(g) or not all(map(math.isfinite, scores)):
                raise ValueError("the reranker's answer does not fit its question")
        except Exception as e:
            if not fallback:
                raise
            scores, reason = [-float(r) for r in g["rank"]], type(e).__name__
        out = g[["query_id", "chunk_id"]].assign(base_rank=g["rank"].astype("int32"), rerank_score=np.asarray(scores, float))
        order = np.lexsort((out["base_rank"], -out["rerank_score"]))
        out["rank"] = np.argsort(order).astype("int32") + 1
        return out.assign(degraded_reason=reason)

    return candidates.select("query_id", "query", "chunk_id", "text", "rank").groupBy("query_id").applyInPandas(
        run, "query_id long, chunk_id string, base_rank int, rerank_score double, rank int, degraded_reason string")


class VectorStore:
    """UDF3: unit vectors under ids, in the order of their insertion. Of equal scores the one added last comes first (TOP2)."""

    def __init__(self) -> None:
        self.rows: DataFrame | None = None
        self.size = 0

    def add(self, rows: DataFrame) -> None:
        """rows: (vec_id, position, embedding)."""
        if not rows.groupBy("vec_id").count().where("count > 1").isEmpty() or (self.rows is not None and not rows.join(self.rows, "vec_id", "left_semi").isEmpty()):
            raise ValueError("ids must be unique")
        new = rows.select("vec_id", (F.col("position") + self.size).alias("position"), V.unit(F.col("embedding")).alias("v"))
        self.rows = new if self.rows is None else self.rows.unionByName(new)
        self.size = len(self)

    def clear(self) -> None:
        self.rows, self.size = None, 0

    def __len__(self) -> int:
        return self.rows.count() if self.rows is not None else 0

    def search(self, queries: DataFrame, k: int) -> DataFrame | None:
        """(query_id, vec_id, score, rank); queries: (query_id, q), a stated set. Matrix products over Arrow batches: only the k best of each batch are shuffled."""
        if self.rows is None:
            return None
        from ..operators.retrieval import vector_hits

        scored = vector_hits(queries, self.rows.withColumnRenamed("v", "embedding"), k, -math.inf, above=-math.inf, last_first=True)
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("position").desc())
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def waits(base: float = 0.5, cap: float = 8.0) -> Iterator[float]:
    """STR14: delays that double up to a cap, each with up to a tenth of it (a quarter of a second at most) on top."""
    delay = base
    while True:
        least = min(delay, cap)
        yield least + random.uniform(0, min(0.25, least / 10))
        delay = 2 * least


#: Parts of the names of exceptions that tell of the way to a server rather than of the request.
TRANSIENT = ("timeout", "connect", "network", "gaierror", "ssl")


def transient(error: Exception) -> bool:
    """Whether asking again may help: rate limits, server errors, and failures on the way."""
    status = getattr(error, "status", None)
    if isinstance(status, int):
        return status == 429 or status >= 500
    return any(part in type(error).__name__.lower() for part in TRANSIENT)


@dataclass
class Policy:
    """STR14: asks again, up to ``retries`` times, after what the server says or else the next of ``delays``, while that ends before the budget does."""

    budget: float = 60.0
    retries: int = 2
    delays: Callable[[], Iterator[float]] = waits
    again: Callable[[Exception], bool] = transient
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    def call(self, operation: Callable[[], object]) -> object:
        deadline = self.clock() + self.budget
        for delay in itertools.islice(self.delays(), self.retries):
            try:
                return operation()
            except Exception as error:
                told = getattr(error, "retry_after", None)
                delay = delay if told is None else told
                if not self.again(error) or self.clock() + delay >= deadline:
                    raise
            self.sleep(delay)
        return operation()


STRUCTURED = "id long, schema string, attempts int, ok boolean, error string, value string"


def structured(prompts: DataFrame, client: LLMClient, required: list[str], schema: str, retries: int = 1) -> DataFrame:
    """UDF4, AGG30: STRUCTURED from prompts (id, prompt): the client's JSON object per prompt, asked again with the error while a required key is missing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ident, prompt in zip(f["id"], f["prompt"], strict=True):
                asked, error, value = prompt, None, None
                for attempt in range(1, retries + 2):
                    found = T.parsed_object(client.generate(asked) or "")
                    missing = [k for k in required if k not in json.loads(found)] if found else required
                    error = None if not missing else "parse" if not found else "missing " + ",".join(missing)
                    if not error:
                        value = found
                        break
                    asked = f"{prompt}\n\nThe last answer was rejected: {error}."
                out.append((ident, schema, attempt, error is None, error, value))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STRUCTURED.split(", ")])

    return prompts.select("id", "prompt").mapInPandas(run, STRUCTURED)


class EchoClient:
    """An offline client: the last line of the prompt as a JSON object; prompts with the word flaky are answered well only when asked again."""

    model_name = "echo"

    def generate(self, prompt: str) -> str:
        first = prompt.split("\n\nThe last answer was rejected")[0]
        if "broken" in first or ("flaky" in first and first == prompt):
            return "no object"
        return "```json\n" + json.dumps({"answer": first.split("\n")[-1]}, ensure_ascii=False) + "\n```"


def question_prompts(chunks: DataFrame) -> DataFrame:
    """UDF8: (id, prompt) that ask for a candidate question about each chunk (position, section, text)."""
    return chunks.select(F.col("position").alias("id"), F.concat(F.lit("Write one question that this passage alone answers, as {\"question\": ...}.\nSection: "), F.coalesce("section", F.lit("none")), F.lit("\n"), T.short(F.col("text"))).alias("prompt"))


class Agent:
    """UDF5: a role of the analysis: a template of named columns, the client that answers, the keys that its answers must have."""

    def __init__(self, name: str, template: str, required: list[str], client: LLMClient, retries: int = 1):
        self.name, self.template, self.required, self.client, self.retries = name, template, required, client, retries

    def run(self, rows: DataFrame) -> DataFrame:
        """rows (id, and the columns that the template names) with the answer as a map, null where none was accepted."""
        prompt = F.lit(self.template)
        for c in rows.columns:
            prompt = F.replace(prompt, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
        found = structured(rows.select("id", prompt.alias("prompt")), self.client, self.required, self.name, self.retries)
        return rows.join(found.select("id", F.from_json("value", "map<string,string>").alias(self.name)), "id", "left")
