"""Errors of the engine."""


class EngineError(Exception):
    """Anything that the engine refuses or that fails below it."""


class MigrationNeeded(EngineError):
    """A table differs from its spec in a way that the configuration doesn't allow to change."""


class DataFormatError(EngineError):
    """Stored bytes or a result's schema aren't as declared."""
