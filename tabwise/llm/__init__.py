"""Training-data operators: joins, packing, filters, extraction and models over text tables."""
