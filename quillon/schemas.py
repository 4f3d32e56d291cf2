"""Declared schemas of the document corpus, the retrieval records and the state tables; and checks of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVISIONS = """id string, kind string, number string, label string, heading string, text string, text_marked string,
parent string, children array<string>, chapter string, part string, schedule string, page_start int, page_end int,
is_amended boolean, amendments array<string>, ord int"""
TABLES = "table_id string, index int, title string, headers array<string>, letters array<string>, page_start int, page_end int, notes array<string>, issues array<string>, n_rows int"
TABLE_ROWS = """row_id string, table_id string, sl_no string, subrow string, sl_label string, row_heading string,
cells map<string,string>, letters map<string,string>, rate string, threshold string, amendment_markers array<string>,
page_start int, page_end int"""
AMENDMENTS = """key string, label string, page int, line_index int, header string, prior_text string, type string,
amending_act string, effective_date string, target_desc string, linked_nodes array<string>, link_method string, linked_node string"""
CROSS_REFS = "from_id string, raw string, ref_type string, to_id string, resolution string"
CHUNKS = """id string, version string, provision_id string, text string, embed_text string, tokens int, page_start int,
page_end int, provisions array<string>, breadcrumb string, kind string, model string, embedding array<float>"""
LINES = """doc_id string, line_index long, page int, bbox array<double>, text string,
spans array<struct<text:string,font:string,size:double,bbox:array<double>>>, markers array<string>"""
HITS = """question_id string, rank int, chunk_id string, provision_id string, score double, text string, tokens int,
page_start int, page_end int, provisions array<string>"""
QUESTIONS = """id string, type string, question string, gold_answer string, gold_facts array<string>,
gold_provisions array<string>, gold_table_rows array<string>,
gold_amendment struct<type:string,prior_text:string,effective_date:string,footnote:string>, should_refuse boolean,
source string, note string, status string"""
EVAL_RECORDS = """id string, type string, question string, metrics map<string,double>,
retrieved array<struct<chunk_id:string,provisions:array<string>>>, embed_tokens long, evidence_tokens long,
llm_tokens long, latency_s double, answer string, refused boolean, cited array<string>"""
EMBEDDING_CACHE = "key string, model string, task string, dim int, vec array<float>"
RERANK_CACHE = "key string, model string, result array<struct<index:int,score:double>>"
MODEL_CACHE = "key string, model string, request string, response string, created string"
LEDGER = "day string, model string, tokens long"


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number: empty where the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent row."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if not duplicate_keys(df, *keys).isEmpty():
        raise ValueError(f"keys repeat: {', '.join(keys)}")
    return df


def assert_fk(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    if not orphans(df, key, parent, parent_key).isEmpty():
        raise ValueError(f"{key} without a row in its parent table")
    return df
