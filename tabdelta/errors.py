"""Errors with a code that callers can act on."""

from __future__ import annotations

#: Codes in use.
CODES = (
    "PASSWORD_REQUIRED", "PASSWORD_WRONG", "ENCRYPTION_UNSUPPORTED", "CORRUPT_FILE", "FILE_TOO_LARGE", "UNSUPPORTED_TYPE",
    "ABORTED", "NO_COMMON_SHEETS", "MERGE_NO_KEY", "MERGE_UNRESOLVED", "MERGE_INVALID_RESOLUTION", "MERGE_XLS",
    "PATCH_SELFCHECK_FAILED", "REPORT_FAILED", "OUT_OF_MEMORY_OR_CRASH",
)


class TabDeltaError(Exception):
    """An error of one of ``CODES`` with its data."""

    def __init__(self, code: str, message: str, **data):
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(message)
        self.code, self.data = code, data
