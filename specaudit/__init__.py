"""Evidence-bound compliance auditing on Spark: retrieval, rules, audits and their evaluation as DataFrame operations."""
