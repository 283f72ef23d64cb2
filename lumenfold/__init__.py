"""Event analytics on PySpark: nested events, weighted histograms, binned-table algebra."""
