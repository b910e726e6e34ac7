"""sluice: compressed byte streams, their containers and checksums as DataFrames."""
