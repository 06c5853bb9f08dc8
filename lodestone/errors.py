"""Errors with SQLSTATE codes."""


class EngineError(Exception):
    def __init__(self, message: str, sqlstate: str = "XX000") -> None:
        super().__init__(message)
        self.sqlstate = sqlstate


class DataError(EngineError):
    """A value or type that doesn't fit."""


class ConstraintError(EngineError):
    """23502 not null, 23503 foreign key, 23505 unique, 23514 check."""


class TransactionError(EngineError):
    """25P02 failed transaction, 40001 conflicting writers."""


class UnsupportedError(EngineError):
    """A shape that is refused rather than approximated."""

    def __init__(self, message: str) -> None:
        super().__init__(message, "0A000")
