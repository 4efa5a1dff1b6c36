"""Column functions: vocabulary, pay, names, URLs, dates, hashes."""
