"""Operators of a training-data pipeline over a table of documents.

Each module is one operator with its own interface; ``queries`` registers one thin query per operator.
Nothing outside this subpackage imports it. Python that runs in tasks is shipped with the plan, so that
executors need not have the package installed."""

from pyspark import cloudpickle

import pitspark.llm as _self

cloudpickle.register_pickle_by_value(_self)
