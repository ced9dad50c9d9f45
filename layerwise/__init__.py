"""Layerwise: audits of layered (bronze, silver, gold) data pipelines on Spark DataFrames."""
