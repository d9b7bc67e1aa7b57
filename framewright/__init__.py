"""Preparation and analysis of multi-camera driving data as Spark jobs.

Every operator takes DataFrames and returns a lazy DataFrame.
"""
