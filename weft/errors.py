"""Named refusals: an operator names the parameter it cannot work with."""

from __future__ import annotations


class OpError(ValueError):
    """Raised while a plan is being built, before any job runs."""

    def __init__(self, op: str, param: str, reason: str):
        super().__init__(f"{op}: {param}: {reason}")
        self.op, self.param, self.reason = op, param, reason


def need_columns(op: str, param: str, df, names) -> None:
    """Refuse columns that ``df`` does not have. Every operator asks this first, so the package is sent to the workers here."""
    from weft.runtime import ship

    ship(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise OpError(op, param, f"no such column: {', '.join(map(repr, missing))}; there are {', '.join(df.columns)}")


def need_one_of(op: str, param: str, value, allowed) -> None:
    if value not in allowed:
        raise OpError(op, param, f"{value!r} is not one of {', '.join(map(str, allowed))}")


def need_positive(op: str, param: str, value) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
        raise OpError(op, param, f"{value!r} is not a positive number")
