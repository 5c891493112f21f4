"""Spark jobs that combine sensor observations with ensembles of model forecasts."""
