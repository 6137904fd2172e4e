"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridgale.llm import alignment, decontamination, html, langid, lexical, minhash, packing, pii, quality, secrets, simhash, urls, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_pii": pii.query,
    "op2_secrets": secrets.query,
    "op3_simhash": simhash.query,
    "op4_minhash": minhash.query,
    "op5_quality": quality.query,
    "op6_langid": langid.query,
    "op7_html": html.query,
    "op8_urls": urls.query,
    "op9_decontamination": decontamination.query,
    "op10_packing": packing.query,
    "op11_warc": warc.query,
    "op12_alignment": alignment.query,
    "op13_lexical": lexical.query,
}

SQL: dict[str, str] = {
    "op4_minhash": minhash.SQL,
    "op8_urls": urls.SQL,
    "op11_warc": warc.SQL,
    "op13_lexical": lexical.SQL,
}
