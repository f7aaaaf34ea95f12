"""PySpark operators that prepare text corpora and conversation data for training."""
