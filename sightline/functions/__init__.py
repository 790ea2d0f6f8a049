"""Column functions: parsing of noisy fields, names and their likeness, hashes and schedules."""
