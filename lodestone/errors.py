"""Refusals with a cause and the exit code of the command line."""

from __future__ import annotations

# Exit codes and causes.
OK, WARNINGS, REFUSED_INPUT, FAILED_CHECK, REFUSED_POLICY, SOURCE_CHANGED = 0, 10, 20, 30, 40, 70
SHAPE, CAPABILITY, REQUEST, RUNTIME = "unsupported_shape", "unsupported_capability", "invalid_request", "runtime_error"
IN_PLACE, NON_EMPTY, FORWARD, VERIFICATION = "forced_in_place_refused", "non_empty_output", "forward_version", "verification_failed"


class Refusal(Exception):
    """Something the engine will not do; code is the exit code, cause one of the causes above."""

    code, name = 1, "error"

    def __init__(self, message: str, cause: str | None = None, mitigation: str | None = None, rules: list[str] | None = None) -> None:
        super().__init__(message)
        self.cause, self.mitigation = cause, mitigation
        self.rules = rules or []  # names of the row rules that were broken


class Unsupported(Refusal):
    code, name = REFUSED_INPUT, "unsupported_input"


class VerificationFailure(Refusal):
    code, name = FAILED_CHECK, "verification_failed"


class PolicyRefusal(Refusal):
    code, name = REFUSED_POLICY, "refused"


class SourceChanged(Refusal):
    code, name = SOURCE_CHANGED, "source_changed"
