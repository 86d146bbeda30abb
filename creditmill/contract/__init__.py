"""Fixed values, schemas and the feature contract."""
