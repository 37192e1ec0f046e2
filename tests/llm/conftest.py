from made import documents  # noqa: F401
