"""siltworks: a Spark-native engine for building and analysing text corpora."""

import sys

from pyspark import cloudpickle

# Executors need not have this repository on their path: functions sent to them carry the code they use.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
