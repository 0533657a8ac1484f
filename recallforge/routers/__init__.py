"""Centroid and candidate routers: small models built on the driver, or inside one segment's task."""
