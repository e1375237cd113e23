"""Data-dictionary analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
``functions``  column expressions (no UDFs)
``operators``  DataFrame -> DataFrame building blocks (cleaning, joins, changes, versions)
``sources``    sheets and tables
``plans``      bronze / silver / golden / metrics
``streaming``  incremental file arrival
"""
