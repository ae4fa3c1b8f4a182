"""Stage operators. Importing registers them under (stage, name)."""

from . import cross, dynamics, markets, meta, stage1  # noqa: F401
