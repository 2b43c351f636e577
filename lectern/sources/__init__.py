"""Readers and writers. Schemas are explicit; an order that matters is a column."""
