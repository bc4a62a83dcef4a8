"""Change-log analytics on Spark: HLC-keyed logs, last-writer-wins tables, set reconciliation, versioned stores."""
