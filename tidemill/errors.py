"""Errors that callers can tell apart."""


class TidemillError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(TidemillError):
    """A pipeline, step or option that can't be meant."""


class ExpressionError(ConfigurationError):
    """An expression that isn't allowed or doesn't compile."""


class TransformationError(TidemillError):
    """Rows that a step can't handle under its policy."""


class ValidationError(TidemillError):
    """Rows that break rules beyond what the policy lets pass."""


class SchemaDriftError(TidemillError):
    """A source whose columns changed beyond what the policy allows."""


class PublishError(TidemillError):
    """A target that couldn't be written."""
