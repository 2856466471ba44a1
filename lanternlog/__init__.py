"""Spark-native log analytics: parse, enrich, detect, correlate, open incidents, ask.

Every operator is a ``DataFrame -> DataFrame`` function.  The same operators
run on stored tables and, through ``lanternlog.streaming``, on live streams.
"""

from lanternlog.params import Params

__all__ = ["Params"]
