"""Lodestone: a PySpark engine for building language-model training corpora."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so a job does not
# depend on the package being importable on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
