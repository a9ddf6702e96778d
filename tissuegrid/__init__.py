"""Tile-grid cohort analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so a session works
# from any folder and without shipping this package to the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
