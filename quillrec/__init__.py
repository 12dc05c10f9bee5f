"""quillrec: recommendation analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with their code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
