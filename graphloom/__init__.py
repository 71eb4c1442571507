"""graphloom: a PySpark-native analytics engine for code-knowledge graphs.

Every public operator takes DataFrames and parameters and returns a lazy
DataFrame.  The subpackages:

* ``functions``  Column-returning helpers (text, paths, vectors, hashes)
* ``operators``  relational, graph, vector, change-capture and memory operators
* ``sources``    readers and writers (source trees, logs, git output, upserts)
* ``streaming``  incremental versions of the change-capture operators
* ``plans``      the query catalogue and its SQL counterparts
* ``llm``        optional operators for training data; nothing else imports it
"""

__version__ = "0.1.0"
