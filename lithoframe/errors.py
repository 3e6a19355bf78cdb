"""Refusals: each names the limit, the value and the remedy."""


class LayerError(ValueError):
    """Input that an operator can't compute over."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise LayerError(message)
