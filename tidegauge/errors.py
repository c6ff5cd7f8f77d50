"""Typed errors. All of them are raised on the driver, at plan time where possible."""


class TidegaugeError(Exception):
    """Base of every error raised by this package."""


class ContractError(TidegaugeError):
    """A dataset does not fit its contract (label, aliases, benign class)."""


class SchemaError(TidegaugeError, ValueError):
    """Required feature or label columns are missing."""


class QualityError(TidegaugeError):
    """A loaded table failed a data-quality check."""


class DatasetNotFoundError(TidegaugeError, FileNotFoundError):
    """A dataset name or its path is unknown."""


class NotFittedError(TidegaugeError, RuntimeError):
    """transform was called before fit."""


class CategoryLimitError(TidegaugeError):
    """A category column has more values than can become one column each."""


class InfiniteValueError(TidegaugeError, ValueError):
    """A number column holds infinite values, which cannot be scaled."""


class SplitKeyError(TidegaugeError):
    """The split key is not unique enough for an exact split."""


class EmptyReportError(TidegaugeError):
    """A drift report has no rows."""


class UnknownAlertError(TidegaugeError, ValueError):
    """A state change names an alert that does not exist."""


class UnsupportedModelError(TidegaugeError, ValueError):
    """No attribution method exists for the given model type."""


class SharedFolderError(TidegaugeError):
    """A cluster session names no shared folder in spark.checkpoint.dir."""
