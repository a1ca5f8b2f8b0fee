"""Operations of a training-data pipeline: one module per operator, their queries and SQL in :mod:`.queries`."""
