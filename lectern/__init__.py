"""Query-focused extractive ranking and summarisation over clusters of documents, as Spark plans."""
