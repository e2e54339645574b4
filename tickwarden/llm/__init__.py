"""Operators for large text corpora (training-data pipelines).

Nothing else in the library imports this subpackage.  Every operator
takes and returns DataFrames; intermediate tables are written below
``spark.checkpoint.dir`` (see :func:`tickwarden.session.scratch_path`).
"""
