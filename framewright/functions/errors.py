"""The error taxonomy: one root, one class for each question a handler may ask."""

from __future__ import annotations


class FrameError(Exception):
    """Any failure of data, configuration, types or destinations."""

    error_class = "FRAME"


class ConfigurationError(FrameError):
    """Is the setup wrong?"""

    error_class = "CONFIGURATION"


class FormatError(FrameError):
    """Are the bytes malformed?"""

    error_class = "FORMAT"


class LimitError(FormatError):
    """Are the bytes well formed but too large?"""

    error_class = "LIMIT"


class NotSupportedError(FrameError):
    """Is this recognized but not available here?"""

    error_class = "FORMAT_NOT_SUPPORTED"


class IntegrityError(FrameError):
    """Can the data be trusted?"""

    error_class = "INTEGRITY"


class EncryptionError(FrameError):
    """Did the encryption itself fail?"""

    error_class = "ENCRYPTION"


class EncryptionKeyError(EncryptionError):
    """Is the key missing, wrong or unusable?"""

    error_class = "ENCRYPTION_KEY"


class StreamError(FrameError):
    """Did the stream fail?"""

    error_class = "STREAM"


class WireTypeError(FrameError):
    """Can the type be handled?"""

    error_class = "TYPE"


CLASSES = {c.error_class: c for c in (FrameError, ConfigurationError, FormatError, LimitError, NotSupportedError, IntegrityError, EncryptionError, EncryptionKeyError, StreamError, WireTypeError)}
