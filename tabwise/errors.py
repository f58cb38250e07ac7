"""Single error type raised when a step cannot run on the supplied data."""


class PipelineError(Exception):
    """Raised for validation failures; the message names the offending columns or values."""
