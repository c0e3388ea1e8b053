"""stowfind: hybrid retrieval over nested, spatially placed inventories, on Spark.

Queries, items, containers and changes are DataFrames; operators take
DataFrames and return DataFrames. Most are lazy; those that measure, iterate
or write tables of their own (nested walks, searches, index changes) run jobs
when they are called.
"""
__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
