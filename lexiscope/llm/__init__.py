"""Operators of a training-data pipeline: nearest neighbours, packing, language
id, sharding, toxicity, near duplicates, decontamination, chat formatting, LM
scoring and quality. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# tasks get this code with their closure, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
