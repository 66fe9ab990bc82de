"""Document-integrity analytics on Spark: diff, risk rules, gate, versioned index, audit log and search as DataFrame jobs."""
