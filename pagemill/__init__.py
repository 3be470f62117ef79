"""Spark-native toolkit for corpora of web pages, documents and event logs."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors with the task, so no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
