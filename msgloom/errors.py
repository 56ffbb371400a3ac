"""Errors a caller may want to catch."""


class SourceNotFound(FileNotFoundError):
    """A raw table is missing at the given place."""


class DatasetNotFound(FileNotFoundError):
    """No stored `messages` dataset at the given place: sync first."""


class SchemaMismatch(ValueError):
    """The stored dataset was written with another schema: migrate it, or sync with force=True."""


class CommitConflict(RuntimeError):
    """Another writer has committed to the dataset meanwhile; nothing of this one is seen."""
