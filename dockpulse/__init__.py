"""Warehouse scan and shipment analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from dockpulse.params import Params
from dockpulse.session import build_session, pin_utc, scratch_dir

__all__ = ["Params", "build_session", "pin_utc", "scratch_dir"]

# Python code that runs in tasks travels by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
