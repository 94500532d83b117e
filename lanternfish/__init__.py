"""Lanternfish: media-sighting analytics as composable Spark DataFrame operators."""
