"""Retrieval and maintenance over long-lived conversational memory, as Spark plans."""
