"""DataFrame -> DataFrame operators over genes, intervals, motif hits, edges and counts."""
