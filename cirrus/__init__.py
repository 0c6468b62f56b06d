"""Cirrus: point-cloud, image, patch and log analytics expressed as Spark jobs."""
