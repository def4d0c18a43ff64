"""Sources: feed adapters, a paged pull as a data source, feed and page scans, and idempotent sinks."""
