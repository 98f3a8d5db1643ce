"""lodestrata: analytics over software-engineering knowledge, as DataFrame plans."""
