"""Spark-native profiling, feature planning and model search for tabular data."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tabprofile.plans.spec import CandidateModel, FeatureStep, TaskSpec  # noqa: E402
from tabprofile.session import build_session  # noqa: E402

__all__ = ["CandidateModel", "FeatureStep", "TaskSpec", "build_session"]
