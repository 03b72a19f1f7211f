"""Running and judging text-classification systems on Spark tables."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
