"""Bank-ledger analytics for many users at once, written as Spark DataFrame jobs."""
