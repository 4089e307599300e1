"""Training-data operators.  Nothing outside this subpackage imports it.

Functions that run on executors are pickled by value, so a cluster needs the
third-party libraries they use but not this package itself.
"""

from pyspark import cloudpickle

from . import chat, decontam, language, linededup, neardup, packing, quality, textkit, toxicity

for _module in (chat, decontam, language, linededup, neardup, packing, quality, textkit, toxicity):
    cloudpickle.register_pickle_by_value(_module)
