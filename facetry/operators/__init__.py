"""DataFrame operators over the modality tables."""
