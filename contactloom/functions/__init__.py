"""Column functions: URLs, page markup, addresses, records."""
