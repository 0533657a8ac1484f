"""Clustered, quantized vector index: training, encoding, search, evaluation, write buffer."""
