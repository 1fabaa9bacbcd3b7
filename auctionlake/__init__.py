"""Foreclosure-auction analytics and training-data operators as Spark DataFrame functions."""
