"""Training-set preparation and run analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from samplewright.plans.epoch import EpochPlan
from samplewright.session import build_session

# Functions sent to Python workers carry their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EpochPlan", "build_session"]
