"""Text fidelity and style analytics over corpora, on the DataFrame API."""

import sys

from pyspark import cloudpickle

# Executors get the code with each task: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
