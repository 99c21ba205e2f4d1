"""News-evidence and corpus analytics on Spark."""
