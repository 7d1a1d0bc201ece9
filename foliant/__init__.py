"""Foliant: a document index and retrieval engine expressed as Spark jobs.

The package keeps a ``files -> chunks -> embeddings`` index as DataFrames and
answers keyword, hybrid, similarity and question queries over it.  Everything
is a lazy DataFrame transformation unless a docstring says otherwise.
"""

__version__ = "0.1.0"
