"""covaria: covariance-based statistics and change detection as Spark plans."""

import sys

from pyspark import cloudpickle

#: Functions that run in Python workers travel with the plan, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
