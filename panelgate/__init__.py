"""Table work around a regression model in production, as Spark DataFrame operators.

Every operator takes and returns DataFrames and stays lazy. Only sinks, steps, the
wrappers that raise, model fits, scoring by stored models and running sums run a job.
"""
