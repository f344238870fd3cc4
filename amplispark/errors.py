"""Errors that input and output can raise."""


class ValidationError(ValueError):
    """Any of the below."""


class OutputNotWritable(ValidationError):
    pass


class OutputDirMissing(ValidationError):
    pass


class DecompressionLimitExceeded(ValidationError):
    pass


class CsvFormat(ValidationError):
    pass


class LineTooLong(ValidationError):
    pass
