"""Declared schemas of the stored entities and the default parameters of retrieval. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    chunk_size: int = 1200
    chunk_overlap: int = 150
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    candidates: int = 20
    evidence: int = 6
    history_messages: int = 12
    history_tokens: int = 2000
    evidence_tokens: int = 6000
    evidence_wrapper: int = 16
    passage_chars: int = 4000
    snippet_chars: int = 1200
    context_chars: int = 600
    comparison_items: int = 12
    comparison_tokens: int = 6000


DEFAULTS = Params()

BLOCK = "struct<block_id:string,page_number:int,x0:double,y0:double,x1:double,y1:double,source_index:int,text:string,font_sizes:array<double>,rotation:int>"
CHUNK = "struct<chunk_id:string,paper_id:string,text:string,section:string,page_start:int,page_end:int,char_start:int,char_end:int>"
STATE = f"document struct<metadata:struct<paper_id:string,title:string,year:int,authors:array<string>>,pages:array<struct<page_number:int,text:string>>,sections:array<struct<name:string,page_start:int,page_end:int>>,chunks:array<{CHUNK}>>"
CASE = (
    "schema_version int, id string, paper_id string, split string, language string, question string, section string, answerable boolean,"
    " relevant_chunk_ids array<string>, minimum_evidence_sets array<array<string>>, distractor_type string, review_status string, frozen boolean"
)
EVENT = "key string, sequence long, event_type string, data string, created_at timestamp"
TRACE = "stage string, branch_id string, duration_ms double, input_tokens long, output_tokens long, cost_usd double"


def validate(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule): one row per violated rule; empty means valid."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))
