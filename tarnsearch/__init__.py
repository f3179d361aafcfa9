"""Hybrid document retrieval as ordinary Spark jobs.

Documents become chunks, chunks become postings and vectors, and whole tables
of questions are answered at once. Every operator is a function from DataFrame
to DataFrame.
"""

__version__ = "0.1.0"
