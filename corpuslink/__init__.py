"""corpuslink: corpus analytics on Spark DataFrames."""

import os
import sys

from pyspark import cloudpickle

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# Executors import the package by name when it is on their path; otherwise the functions travel with their code.
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
