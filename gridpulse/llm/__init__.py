"""Operators for large training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# task functions travel with their code, so workers need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
