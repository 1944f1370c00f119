"""Training-data operators: quality, deduplication, archives, decontamination, packing, formatting, token files."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
