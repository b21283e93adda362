"""Document retrieval and corpus preparation as DataFrame operators."""
