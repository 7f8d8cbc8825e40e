"""Literature analytics on Spark: documents, passages, questions and replies as tables and streams."""
