"""Clean a messy business catalogue, index it and answer tables of questions, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Worker code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
