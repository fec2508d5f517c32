"""docveil: finding and rewriting personal data in documents, on Spark."""
