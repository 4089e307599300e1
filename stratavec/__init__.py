"""Search over document collections on Spark: vectors, text, filters, fusion."""

from pyspark import cloudpickle

from . import errors, types
from .engine import VERSION, Config, init, is_initialized, shutdown, version
from .functions import quantizers, text, vector
from .operators import fusion, search
from .schema import CollectionSchema, Field
from .sources.collection import Collection, Options, Route

for _module in (errors, types, quantizers, text, vector, fusion, search):  # executors need no copy of this package
    cloudpickle.register_pickle_by_value(_module)

__all__ = ["VERSION", "Collection", "CollectionSchema", "Config", "Field", "Options", "Route", "init", "is_initialized", "shutdown", "version"]
