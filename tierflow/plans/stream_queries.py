"""Registered queries: streaming ingest and live summary (run to completion with
``availableNow``, then read back from their sinks).  The oracle is the batch
roll-up of the same rows."""
from __future__ import annotations

from tierflow.streaming import log_stream as LS

SPARK = {
    "stream_log": LS.stream_log,
    "stream_summary": LS.stream_summary,
}

ORACLE = {
    "stream_log": ([], """
SELECT request_id, created_at, mode, final_tier, input_tokens, output_tokens, total_latency_ms,
       CAST(1 AS BIGINT) AS n_rows, 'logged' AS outcome
FROM usage_events
UNION ALL
SELECT NULL, created_at, mode, final_tier, input_tokens, output_tokens, total_latency_ms, 1, 'logged'
FROM usage_events, (VALUES (1), (2)) AS copies(n) WHERE CAST(request_id AS BIGINT) % 41 = 0
UNION ALL
SELECT request_id, NULL, mode, final_tier, input_tokens, output_tokens, total_latency_ms, 1, 'missing_time'
FROM usage_events WHERE CAST(request_id AS BIGINT) % 43 = 0
UNION ALL
SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, 1, 'duplicate_request_id'
FROM usage_events WHERE CAST(request_id AS BIGINT) % 50 = 0"""),
    "stream_summary": ([], """
SELECT day, mode, final_tier, requests, input_tokens, output_tokens, ROUND(lat, 4) AS total_latency_ms,
       ROUND(cost, 9) AS total_cost_usd, ROUND(base, 9) AS tier_3_equivalent_cost_usd,
       ROUND(base - cost, 9) AS estimated_savings_usd
FROM (
  SELECT g.*, CAST(input_tokens AS DOUBLE) / 1000000 * p.input_cost_per_million
              + CAST(output_tokens AS DOUBLE) / 1000000 * p.output_cost_per_million AS cost,
         CAST(input_tokens AS DOUBLE) / 1000000 * t.input_cost_per_million
              + CAST(output_tokens AS DOUBLE) / 1000000 * t.output_cost_per_million AS base
  FROM (SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, mode, final_tier, COUNT(*) AS requests,
               CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
               SUM(total_latency_ms) AS lat
        FROM (SELECT * FROM usage_events UNION ALL
              SELECT e.* FROM usage_events e, (VALUES (1), (2)) AS copies(n) WHERE CAST(request_id AS BIGINT) % 41 = 0) u
        GROUP BY 1, 2, 3) g
  JOIN price p ON p.tier = g.final_tier JOIN price t ON t.tier = 'tier_3') x"""),
}
