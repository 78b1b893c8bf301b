"""marlstone: a Spark-first engine for document knowledge retrieval and conversation analytics."""
