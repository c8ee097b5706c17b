"""Service-directory building, checking and matching as Spark DataFrame transformations."""
