"""arealmap: area cartograms and proportional geometry as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
