"""itembank: question-bank curation on Spark DataFrames."""
