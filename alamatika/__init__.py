"""Alamatika: Indonesian address validation and quality scoring on Spark.

Free-text addresses are matched against a gazetteer of administrative regions
(province > city > district > subdistrict + postal code) with DataFrame operations
only, in batch or through Structured Streaming.
"""
