"""Training-data operators: filtering, deduplication, tokenising, search and mixing."""
