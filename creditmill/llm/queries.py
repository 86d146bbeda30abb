"""The registered queries of the text operators and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditmill.llm import (
    align,
    chat,
    exact_dedup,
    licenses,
    mixture,
    packing,
    quality,
    ranked,
    secrets,
    simhash,
    substring_dedup,
    url_filter,
    warc,
)
from creditmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": _over("documents", exact_dedup.digest),
    "op2_quality_rules": _over("documents", quality.digest),
    "op3_simhash_near_dedup": _over("documents", simhash.digest),
    "op4_license_scan": _over("documents", licenses.digest),
    "op5_substring_dedup": _over("documents", substring_dedup.digest),
    "op6_secret_scan": _over("documents", secrets.digest),
    "op7_url_filter": _over("pages", url_filter.digest),
    "op8_source_mixture": _over("documents", mixture.digest),
    "op9_packing": _over("documents", packing.digest),
    "op10_chat_quotes": _over("conversations", chat.digest),
    "op11_ranked_search": lambda spark, sf_dir: ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_warc": _over("pages", warc.digest),
    "op13_token_alignment": _over("documents", align.scores),
}

SQL: dict[str, str] = {
    "op1_exact_dedup": EXACT_SQL,
    "op2_quality_rules": quality.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_source_mixture": mixture.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_warc": warc.SQL,
}
