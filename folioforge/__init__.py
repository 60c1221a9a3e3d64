"""Document intake on Spark: sources, text rules, recovery, validation and a register, as DataFrame operations."""
