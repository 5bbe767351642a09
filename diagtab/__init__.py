"""PySpark-native analytics over requirement texts and class diagrams.

Every public function takes DataFrames (or Columns) and returns DataFrames
(or Columns); none of them runs a Spark action on its own.
"""
