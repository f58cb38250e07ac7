"""Plans: the registered query catalog and the four end-to-end workflows."""
