"""Analytic operators.

Each takes DataFrames and returns a lazy DataFrame. ``filt`` is a Column from ``playtrail.plans.filters``
and applies below the aggregation; ``as_of`` stands for the current time.
"""
