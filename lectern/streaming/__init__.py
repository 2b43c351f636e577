"""Retrieval over a stream of documents: an extension beyond the batch system."""
