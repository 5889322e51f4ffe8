"""Errors of the database layer."""


class BrindleError(Exception):
    """Base of all errors that this library raises on purpose."""


class ParseError(BrindleError):
    """The statement's text is not understood."""


class CatalogError(BrindleError):
    """A name exists already, or does not exist."""


class ConstraintError(BrindleError):
    """A value does not fit its column, or a NOT NULL, UNIQUE, PRIMARY KEY or CHECK constraint fails."""


class TransactionError(BrindleError):
    """BEGIN inside a transaction, or COMMIT or ROLLBACK outside of one."""
