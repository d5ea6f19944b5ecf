"""Course-level risk-model data sets on Spark: cohort, features, models, evaluation."""

__version__ = "0.1.0"
