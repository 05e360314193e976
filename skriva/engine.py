"""The façade: each call returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunks as C
from .operators import compare, evaluate, evidence, retrieval, store
from .schemas import DEFAULTS, Params


class Engine:
    def __init__(self, spark: SparkSession, params: Params = DEFAULTS):
        self.spark, self.params = spark, params

    def ingest(self, documents: DataFrame) -> DataFrame:
        """documents (doc_id, text, ...) with texts stripped and blank ones dropped."""
        from .functions.text import strip

        return documents.withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")

    def chunk(self, documents: DataFrame, scope: str | None = None, section: str | None = None) -> DataFrame:
        c = C.chunk_spans(self.ingest(documents), size=self.params.chunk_size, overlap=self.params.chunk_overlap)
        c = c.withColumn("chunk_id", C.chunk_id(F.col("doc_id"), F.lit(1), F.col("chunk_index"))).withColumn("position", C.position(F.col("doc_id"), F.col("chunk_index")))
        return c.withColumn("scope", F.col(scope).cast("string") if scope else F.lit("all")).withColumn("section", F.col(section) if section else F.lit(None).cast("string")).withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(1))

    def search(self, queries: DataFrame, chunks: DataFrame, top_k: int = 8, vectors: tuple = (), section: str | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
        return retrieval.search(queries, chunks, top_k, list(vectors), self.params, section, pages)

    def ask_context(self, queries: DataFrame, chunks: DataFrame, min_score: float = 0.0) -> DataFrame:
        """Ranked evidence after the score filter, within the token budget."""
        top = retrieval.ranked(retrieval.bm25(queries, chunks, self.params, k=self.params.candidates), self.params.candidates).where(F.col("score") >= min_score)
        top = retrieval.ranked(top.drop("rank"), self.params.evidence)
        return evidence.evidence_budget(top.join(chunks.select("chunk_id", "text"), "chunk_id"), self.params.evidence_tokens)

    def compare(self, chunks: DataFrame, focus: str, key: str = "doc_id") -> DataFrame:
        scored = compare.scored_chunks(chunks, focus)
        picked = compare.select_greedily(scored, key, "chunk_index", self.params.comparison_items, self.params.comparison_tokens)
        return compare.matrix(picked, key)

    def evaluate(self, cases: DataFrame, ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
        return evaluate.metrics(evaluate.observations(cases, ranked), by)

    def tasks(self, tasks: DataFrame, status: str | None = None, term: str | None = None) -> DataFrame:
        return store.listing(tasks, F.col("title"), F.col("task_id"), status, term)

    def events(self, events: DataFrame, cursors: DataFrame, key: str = "key", limit: int = 1000) -> DataFrame:
        return store.after(events, cursors, key, limit)
