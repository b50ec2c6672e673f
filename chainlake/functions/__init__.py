"""Column functions: hashing, byte encoding, canonical JSON and text helpers."""
