"""minpair: grammatical minimal-pair evaluation of language models on Spark.

Every operator is a DataFrame -> DataFrame function. Sub-packages:

- ``sources``   table readers, suite scans, sinks, fixed dimension tables
- ``functions`` column expressions (strings, rounding, arrays, labels)
- ``operators`` relational building blocks (tokens, batches, scoring,
                accuracy, results, summaries, distributed ranking)
- ``plans``     end-to-end query plans built from the operators
- ``streaming`` Structured Streaming versions of the incremental loops
"""

from minpair.session import get_session, checkpoint_dir, durable_checkpoint

__all__ = ["get_session", "checkpoint_dir", "durable_checkpoint"]
