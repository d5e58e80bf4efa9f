"""logtide: download-traffic analytics written as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from logtide.schema import LogSchema, get_schema, register_schema, schema_names

# Pandas functions travel to the executors with their code, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["LogSchema", "get_schema", "register_schema", "schema_names"]
