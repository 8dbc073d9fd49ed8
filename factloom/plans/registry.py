"""All named jobs and the SQL that checks them."""

from __future__ import annotations

from factloom.plans import api_queries, detail_queries, dispatch_queries, market_queries, metering_queries, page_queries, payload_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for module in (page_queries, market_queries, metering_queries, payload_queries, stream_queries, api_queries, dispatch_queries, detail_queries):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
