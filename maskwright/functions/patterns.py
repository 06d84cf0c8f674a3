"""Detector patterns in Java syntax.

Java's word boundary is Unicode-aware and its white space includes vertical tab, so both are spelled out.
Java also backtracks: a pattern tried from every position of one long unbroken run costs the square of the
run. A match that exists from inside a run also exists from the first place in the run where one may start, so
the patterns below only start there, and their cost stays in proportion to the text.
"""

from __future__ import annotations

WORD = r"\w"  # ASCII in Java unless asked otherwise, and one table lookup where the spelled-out class is four
RUN = r"\w\-"
SPACE = r"\t\n\f\r "
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# First word boundary of a run of word characters and hyphens; after nine hyphens any word start counts.
RUN_START = (
    f"(?<![{WORD}])(?=[{WORD}])(?>(?<![{RUN}])|(?<=(?:^|[^{RUN}])-{{1,8}})|(?<=-{{9}}))"
)

EMAIL = r"(?:(?<![\w.%+\-])|\G)[\w.%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = rf"\+?\d[\d{SPACE}\-]{{7,}}"
TOKEN = f"{RUN_START}[{RUN}]{{20,}}{BOUNDARY}"
# A match may leave hyphens before a dot behind; the next one then starts at them.
JWT = rf"(?:{RUN_START}|(?<=[{WORD}])(?=-++\.))[{RUN}]++\.[{RUN}]++\.[{RUN}]+{BOUNDARY}"

# Keys and secrets without a form of their own lie within one of these runs, which reach as far as they can: what
# stands around a run is in none of their patterns, so that they may be sought in each run as in a text of its own.
LONG_RUN = r"[\w\-+/=]{20,}"

# A cheap necessary condition, tested before the pattern.
JWT_HINT = rf"[{RUN}]\.[{RUN}]++\.[{RUN}]"

WORDS = r"[\p{L}\p{Nd}]+"
UNICODE_SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
