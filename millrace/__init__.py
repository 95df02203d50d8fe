"""Demand forecasting and inventory planning as Spark DataFrame pipelines."""
