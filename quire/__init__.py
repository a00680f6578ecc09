"""quire: set-based analytics over corpora of versioned, section-structured documents, on Spark."""
