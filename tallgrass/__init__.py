"""Price-panel factor analytics as Spark DataFrame operations.

operators: formula operators (row-wise, window, pair); functions: formula language and metrics;
plans: backtest, rollover, selection, search, simulation; sources: panel adapters, reads, keyed upserts;
streaming: incremental bars and upserts.
"""
