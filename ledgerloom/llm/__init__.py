"""Training-data pipeline operators; nothing outside this folder depends on them."""
