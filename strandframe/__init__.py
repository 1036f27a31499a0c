"""Columnar analytics on sequencing reads and text corpora, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
