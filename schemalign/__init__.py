"""Schema alignment on Spark: match foreign column names to a standard schema and conform data to it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Python functions run by tasks travel with the job, so executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
