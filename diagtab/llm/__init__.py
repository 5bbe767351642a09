"""Operators for training-data corpora: deduplication, decontamination, mixing, counting, labelling, formatting.

Functions that run in Python workers travel with the job, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
