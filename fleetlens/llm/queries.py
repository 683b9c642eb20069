"""Queries over the given tables, one for each training-data operator, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.chat_format import ORACLE as CHAT_ORACLE
from fleetlens.llm.chat_format import op11_chat_format
from fleetlens.llm.decontaminate import ORACLE as LEAKS_ORACLE
from fleetlens.llm.decontaminate import op6_decontaminate
from fleetlens.llm.filter_audit import ORACLE as AUDIT_ORACLE
from fleetlens.llm.filter_audit import op13_filter_audit
from fleetlens.llm.html_extract import op2_html_extract
from fleetlens.llm.jaccard import op3_jaccard
from fleetlens.llm.langid import op1_langid
from fleetlens.llm.quality import op7_quality
from fleetlens.llm.sentencepiece_fst import op5_sentencepiece
from fleetlens.llm.sharding import op9_sharding
from fleetlens.llm.suffix_dedup import op8_suffix_dedup
from fleetlens.llm.tokenizer_alignment import op12_alignment
from fleetlens.llm.topk import op10_topk
from fleetlens.llm.warc import op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_html_extract": op2_html_extract,
    "op3_jaccard": op3_jaccard,
    "op4_warc": op4_warc,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sharding": op9_sharding,
    "op10_topk": op10_topk,
    "op11_chat_format": op11_chat_format,
    "op12_alignment": op12_alignment,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op6_decontaminate": LEAKS_ORACLE,
    "op11_chat_format": op11_chat_format,
    "op12_alignment": op12_alignment,
    "op11_chat_format": CHAT_ORACLE,
    "op13_filter_audit": AUDIT_ORACLE,
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
            FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
        h AS (SELECT page_id, keeper, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
        bits AS (SELECT *, [CAST(('0x' || substr(hex, i * 10 + 1, 10)) AS BIGINT) FOR i IN range(4)] AS fives FROM h)
        SELECT page_id, payload_bytes,
            list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((fives[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) AS INTEGER) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
        FROM bits""",
}
