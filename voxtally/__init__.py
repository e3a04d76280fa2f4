"""Opinion analytics on Spark: operators from raw comments to evaluated models."""
