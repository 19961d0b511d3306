"""Preparing text corpora for training: cleaning, de-duplication, scoring and packing of documents."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors whole, so that they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
