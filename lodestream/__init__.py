"""lodestream: a Spark-first engine for chat-thread reconstruction, chunking, vector retrieval and document stores."""

__version__ = "0.1.0"
