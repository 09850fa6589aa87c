"""A PySpark engine for explainable message risk scores, with training-data operators in ``veracast.llm``."""
