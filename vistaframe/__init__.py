"""vistaframe: look closely at tabular data with ordinary Spark DataFrame plans."""
