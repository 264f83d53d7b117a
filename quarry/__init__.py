"""quarry: a Spark-first retrieval and corpus-processing engine.

Everything is a lazy DataFrame until the caller acts.  ``operators`` hold the
relational operators, ``sources`` the readers and writers, ``functions`` the
scalar expressions, ``plans`` the search planner, ``streaming`` the
incremental queries.  The optional subpackage ``llm`` holds training-data
operators; nothing outside it imports it.
"""
