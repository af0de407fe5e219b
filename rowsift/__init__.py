"""rowsift: find records by a search term and review them against a guideline, on Spark.

Sub-packages:
  functions  column expressions (text form, term clean-up, strict JSON, verdicts)
  sources    table readers, metadata, document assembly, result writers
  operators  filters, row ids, requests, scorers, reply handling, run log
  plans      the end-to-end review job
  streaming  the same filter + rules review on a streaming DataFrame
"""

__version__ = "0.1.0"
