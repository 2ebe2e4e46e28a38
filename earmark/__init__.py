"""Label, score and interval analytics for sound-event data on PySpark.

Every public function takes DataFrames (and plain parameters) and returns a DataFrame.
"""
