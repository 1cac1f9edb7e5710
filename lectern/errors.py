"""Typed errors. In batch plans the same codes are values of a column ``error_code``."""

from __future__ import annotations

# Codes, each with the status that a service answers with.
STATUS = {
    "INTERNAL_ERROR": 500, "CONFIG_ERROR": 500, "VALIDATION_ERROR": 422, "UNSUPPORTED_FORMAT": 415, "FILE_TOO_LARGE": 413,
    "EMPTY_DOCUMENT": 422, "PARSE_ERROR": 422, "NO_TEXT_LAYER": 422, "INVALID_QUESTION": 422, "DOCUMENT_NOT_FOUND": 404,
    "DOCUMENT_EXISTS": 409, "EMBEDDING_UNAVAILABLE": 503, "EMBEDDING_AUTH": 502, "VECTOR_STORE_UNAVAILABLE": 503, "STORAGE_LOCKED": 503,
    "STORAGE_ERROR": 503,
}

FILE_TOO_LARGE = "FILE_TOO_LARGE"
EMPTY_DOCUMENT = "EMPTY_DOCUMENT"
UNSUPPORTED_FORMAT = "UNSUPPORTED_FORMAT"
PARSE_ERROR = "PARSE_ERROR"
NO_TEXT_LAYER = "NO_TEXT_LAYER"
INVALID_QUESTION = "INVALID_QUESTION"
VALIDATION_ERROR = "VALIDATION_ERROR"
DOCUMENT_NOT_FOUND = "DOCUMENT_NOT_FOUND"
VECTOR_STORE_UNAVAILABLE = "VECTOR_STORE_UNAVAILABLE"


class LecternError(Exception):
    """An error with a code; ``details`` are safe to show."""

    code = "INTERNAL_ERROR"

    def __init__(self, message: str = "", **details: object):
        super().__init__(message)
        self.details = details

    @property
    def status(self) -> int:
        """Status that a service answers with."""
        return STATUS[self.code]

    def envelope(self) -> dict:
        """The error as a plain record."""
        return {"error": {"code": self.code, "message": str(self), "details": self.details}}


class ConfigError(LecternError):
    """Settings or thresholds that can't be used."""

    code = "CONFIG_ERROR"


class VerificationError(LecternError):
    """Staged rows that are not complete, so that they must not be published."""

    code = "STORAGE_ERROR"


class NotFoundError(LecternError):
    """No active document of that id."""

    code = DOCUMENT_NOT_FOUND


class EmbeddingUnavailableError(LecternError):
    """A provider that does not answer, or not as agreed."""

    code = "EMBEDDING_UNAVAILABLE"


class EmbeddingAuthError(LecternError):
    """A provider that refuses the key or the model; ``details`` name the models it allows."""

    code = "EMBEDDING_AUTH"


class LockedError(LecternError):
    """A store that another writer holds."""

    code = "STORAGE_LOCKED"
