"""Secret detectors, from the public key formats of the vendors.

`any_of` is a cheap test for texts worth scanning, `in_run` tells that only long runs are, `lead` is the part of a match that is not secret.

A pattern that has to look far ahead would do so again from every repeated beginning of a hopeless text. Such a pattern has a
second branch, which takes a hopeless stretch as a whole: as far as no match can begin in it. `holds` tells real matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from maskwright.functions.patterns import BOUNDARY, LONG_RUN, SPACE


@dataclass(frozen=True)
class SecretRule:
    type: str
    pattern: str
    any_of: tuple[str, ...] = ()
    case_blind: bool = False
    in_run: bool = False
    lead: str | None = None
    exact_length: int | None = None
    min_entropy: float | None = None
    letter_and_digit: bool = False
    holds: str | None = None
    score: float = 0.99


def _assigned(name: str) -> str:
    return rf"(?i:{name})[\"']?[{SPACE}]*[=:][{SPACE}]*[\"']?"


_DB_SCHEME = r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)"

SECRET_RULES = [
    SecretRule("aws_access_key", f"{BOUNDARY}(?:AKIA|ASIA)[A-Z0-9]{{16}}{BOUNDARY}", any_of=("AKIA", "ASIA")),
    SecretRule(
        "aws_secret_key",
        _assigned("aws_secret_access_key") + "[A-Za-z0-9/+=]{40,}",
        any_of=("aws_secret_access_key",),
        case_blind=True,
        lead="^" + _assigned("aws_secret_access_key"),
        exact_length=40,
    ),
    SecretRule(
        "aws_session_token",
        _assigned("aws_session_token") + "[A-Za-z0-9/+=]{100,}",
        any_of=("aws_session_token",),
        case_blind=True,
        lead="^" + _assigned("aws_session_token"),
    ),
    SecretRule("gcp_api_key", r"AIza[0-9A-Za-z_\-]{35}", any_of=("AIza",)),
    SecretRule(
        "gcp_service_account",
        rf'"type"[{SPACE}]*:[{SPACE}]*"service_account"',
        any_of=('"service_account"',),
    ),
    SecretRule(
        "azure_connection_string",
        "DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]+",
        any_of=("DefaultEndpointsProtocol=",),
    ),
    SecretRule(
        "azure_sas_token",
        # without a signature in the rest of the run, none of its beginnings has one
        rf"sv=\d{{4}}-\d{{2}}-\d{{2}}&(?:[^{SPACE}\"'<>]*sig=[A-Za-z0-9%+/=]+|[^{SPACE}\"'<>]*+)",
        any_of=("sig=",),
        holds=r"sig=[A-Za-z0-9%+/=]+\z",
    ),
    SecretRule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----)?",
        any_of=("PRIVATE KEY-----",),
    ),
    SecretRule(
        "db_url",
        # up to a sign that no password has, unless that is an @ with a host, there is no match
        rf"(?i){_DB_SCHEME}://(?:[^{SPACE}:/@\"']*:[^{SPACE}@\"']++@[^{SPACE}\"'<>]+|[^{SPACE}@\"']*+(?!@[^{SPACE}\"'<>]))",
        any_of=("://",),
        holds="@",
    ),
    SecretRule(
        "high_entropy",
        LONG_RUN,
        in_run=True,
        min_entropy=4.5,
        letter_and_digit=True,
        score=0.7,
    ),
    SecretRule(
        "hex_secret",
        f"{BOUNDARY}[0-9a-fA-F]{{32,}}{BOUNDARY}",
        in_run=True,
        min_entropy=3.0,
        score=0.75,
    ),
]
