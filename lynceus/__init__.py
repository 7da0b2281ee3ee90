"""Lynceus: cohort auditing, sampling, modelling and model comparison on Spark DataFrames."""
