"""Typed refusals: each stops a computation whose result would be silently wrong."""


class PoolstatError(ValueError):
    """Base of all refusals."""


class DifferentialAttrition(PoolstatError):
    """An arm was seen but has no completed row."""


class NoCellsSelected(PoolstatError):
    """No row is left after exclusions; the message counts them."""


class NoStoredConfig(PoolstatError):
    """The store holds no study cell."""


class AmbiguousStoredConfig(PoolstatError):
    """The store holds several configurations and none was named."""


class UnknownStoredConfig(PoolstatError):
    """A named configuration is not held."""


class PoolsUnavailable(PoolstatError):
    """No row of the contrast has a pool: the lane is reported as not computed."""


class MixedPoolCoverage(PoolstatError):
    """Some rows of the contrast have pools and some have not."""


class JudgeScoresUnavailable(PoolstatError):
    """No score record matches, or under two judge providers are present."""


class BiasNotIdentifiable(PoolstatError):
    """The same-provider flag is constant within every judge."""


class FitUnavailable(PoolstatError):
    """A mixed-model fit failed or is malformed: a hard stop, not a reason to descend."""


class FitSchema(FitUnavailable):
    """A fit's coefficient names or shapes are not those asked for."""


class ConflictingRecord(PoolstatError):
    """A key is stored already with other content."""


class MissingRate(PoolstatError):
    """A model has no rate where spend must not be priced at zero."""


def check(ok: bool, message: str, kind: type[PoolstatError] = PoolstatError) -> None:
    if not ok:
        raise kind(message)
