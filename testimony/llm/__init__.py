"""Operations of a training-data pipeline: mixing, deduplication, scoring, filtering, sharding."""
