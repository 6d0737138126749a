class DatasetError(Exception):
    """The input or processed data set is missing or lacks expected columns."""


class VectorTableError(Exception):
    """The vector table is missing or empty."""
