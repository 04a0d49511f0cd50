"""Reading corpora, and writing and managing named indexes."""
