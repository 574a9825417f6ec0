"""Exceptions raised on the driver when a check on the data fails."""


class DataCheckError(ValueError):
    """Rows break a rule the next step relies on."""


class MergeKeyError(DataCheckError):
    """Two tables share no usable merge key."""


class MergeExplosionError(DataCheckError):
    """Both sides repeat merge keys, so a join would multiply rows."""


class ArtifactError(ValueError):
    """A saved model bundle is incomplete or inconsistent."""
