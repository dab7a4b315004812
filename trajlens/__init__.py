"""Find outlying entities in large tables of multivariate time series, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from trajlens.roles import Roles

__all__ = ["Roles"]

# Executors may lack this package: what runs there is pickled with its code instead of by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
