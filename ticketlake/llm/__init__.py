"""Corpus operators for training-data pipelines over a table of documents.

Functions that run in tasks travel to the executors with their code, so a cluster's Python workers
needn't have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
