"""The query language: parsing, verbs and the scheduling of statements."""
