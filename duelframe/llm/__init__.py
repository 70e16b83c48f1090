"""Operators for preparing training corpora; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: functions travel with the tasks that run them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
