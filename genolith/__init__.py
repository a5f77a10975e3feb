"""Genotype-imputation analytics and training-data operators on PySpark."""
