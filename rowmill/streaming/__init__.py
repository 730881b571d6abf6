"""Streams over the batch operators."""

import sys

from pyspark import cloudpickle

# State processors run in Python workers; they travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
