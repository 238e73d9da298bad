"""Marine oil-spill investigation as Spark DataFrame jobs."""
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Helpers that run inside tasks travel with the job, so executors need no installation.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
