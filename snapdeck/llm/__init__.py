"""Operators of a training-data pipeline. Functions that run in Arrow tasks are
shipped with the job, so executors need numpy and pyarrow only."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
