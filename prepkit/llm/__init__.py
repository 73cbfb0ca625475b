"""Operators for building training corpora: cleaning, deduplication, scoring, mixing, sharding.

Nothing else in the package imports this one. Task functions travel to the executors by
value, so a cluster needs numpy, pandas and pyarrow there but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
