"""Why a file gave no pages."""


class Unreadable(Exception):
    """A file that can't be read; the text says why."""


class Skipped(Exception):
    """A file of a kind without a reader here."""
