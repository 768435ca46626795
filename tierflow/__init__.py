"""tierflow: Spark-native analytics for cost-aware model routing.

Sub-packages:
  sources    -- table readers, fixture views, log / benchmark sinks
  functions  -- Column-level building blocks (features, labels, judge text)
  operators  -- DataFrame operators (labels audit, policy, settlement, reports,
                judge batches, text model)
  plans      -- the query registry and the oracle SQL shared with DuckDB
  streaming  -- Structured Streaming ingest and live summary
"""
