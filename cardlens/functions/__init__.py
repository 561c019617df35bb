"""Column functions: seeded hashing and sketch codecs."""
