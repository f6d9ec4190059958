"""lexiscope: text-authorship analytics as Spark DataFrame / SQL / ML jobs.

Sub-packages
------------
sources    readers, writers and the fixture views built from the driver tables
functions  Column -> Column text and scalar expressions (all JVM-side)
operators  DataFrame -> DataFrame operators: sampling, profiling, lookups,
           text features, token graphs, metrics, Spark ML models
plans      end-to-end jobs (evaluation, baseline train/score, graph features)
           and the query catalogue used by ``__spark_entry__``
streaming  the scoring and evaluation jobs over a file stream
"""

__version__ = "0.1.0"
