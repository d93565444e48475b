"""Document-structure and accessibility analytics on Spark."""
