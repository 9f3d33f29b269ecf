"""carlake: vehicle-safety, fuel-economy and market analytics as Spark DataFrame jobs."""
