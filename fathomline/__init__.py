"""Hybrid retrieval over catalogue data, written as Spark jobs.

The package answers whole tables of queries against whole tables of items:
exact structured filters, nearest vectors, trigram name matching, rank fusion
and reranking, fed by an incremental ingest and a change stream.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a job
# needs no installation of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
