"""Spark-native analysis of multi-lead waveform records held as tables."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
