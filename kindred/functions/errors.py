"""Parameters are strict and raise these when a plan is built; data are lenient and never raise."""


class MatchError(ValueError):
    """Base of all parameter errors."""


class InvalidQGramSize(MatchError): ...


class InvalidTverskyParam(MatchError): ...


class InvalidAlgoID(MatchError): ...


class InvalidInnerAlgo(InvalidAlgoID): ...


class EmptyScorer(MatchError): ...


class InvalidWeight(MatchError): ...


class InvalidThreshold(MatchError): ...


class MissingThreshold(MatchError): ...


class InternalInvariantViolated(MatchError): ...


class InvalidSWGParam(MatchError): ...


class NilScorer(MatchError): ...


class InvalidItem(MatchError): ...


class InvalidConfig(MatchError): ...
