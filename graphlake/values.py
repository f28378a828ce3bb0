"""Small shared values."""


class _Unset:
    """A key given with this value counts as not given; None is SQL's NULL."""

    def __repr__(self) -> str:
        return "UNSET"

    def __bool__(self) -> bool:
        return False


UNSET = _Unset()


def given(args: dict | None) -> dict:
    """The entries that are set."""
    return {k: v for k, v in (args or {}).items() if v is not UNSET}
