"""Faults of a PDF as data: a stable code and a message."""

from __future__ import annotations

#: The codes of fatal faults.
CODES = (
    "InvalidHeader", "InvalidXref", "InvalidObject", "UnexpectedToken", "UnexpectedEof",
    "BadStream", "MissingTrailer", "ObjectNotFound", "Unsupported", "BadPassword",
)
#: The codes of faults in spite of which a file is read.
LINTS = ("RecoveredXref", "LengthMismatch", "DroppedObject")


class PdfError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message

    def __reduce__(self):
        return PdfError, (self.code, self.message)
