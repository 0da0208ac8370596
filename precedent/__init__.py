"""precedent: precedent retrieval as Spark DataFrame-to-DataFrame functions.

Sub-packages:
  sources    readers and writers (JSON arrays, lookups, the case collection)
  functions  Column-level expressions (strict JSON, vectors, HTML, text)
  operators  DataFrame operators (harvest, responses, enrich, documents,
             retrieve, report, quality)
  plans      the named queries over the driver tables and their SQL oracles
  streaming  the request stream (Structured Streaming + foreachBatch)
"""

from precedent.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
