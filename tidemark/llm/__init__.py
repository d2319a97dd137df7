"""Operations of a training-data pipeline: counting, scoring, encoding, deduplicating and packing documents."""
