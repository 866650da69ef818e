"""tessera: Spark-native preparation and scoring of text-completion corpora.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from Spark SQL
expressions.  Sub-packages:

* ``sources``   -- table scans, derived views, sinks (ledger, vocabulary, results)
* ``functions`` -- column-level helpers (tokens, n-grams, code points, hashing)
* ``operators`` -- sampling, tokenization, batching, masking, candidates,
                   metrics, corpus exploration
* ``plans``     -- the query registry used by ``__spark_entry__`` and the bench
* ``streaming`` -- the step-log rollup on ``readStream``
"""

__version__ = "0.1.0"
