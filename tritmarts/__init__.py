"""Sensor-journal analytics as Spark DataFrame jobs."""
