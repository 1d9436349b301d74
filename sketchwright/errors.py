"""Errors of the library; both are ValueErrors."""


class SketchError(ValueError):
    """What is wrong, with the values that show it."""

    def __init__(self, message: str, **context: object):
        self.message, self.context = message, context
        shown = ", ".join(f"{k}: {v}" for k, v in context.items())
        super().__init__(f"{message} ({shown})" if shown else message)


class SketchArgumentError(SketchError):
    """A parameter or a combination of summaries that can't be used."""


class SketchDataError(SketchError):
    """Stored bytes that are no valid summary."""
