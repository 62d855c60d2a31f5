"""Evidence-first analytics on Spark: printed facts to verified, versioned series."""
