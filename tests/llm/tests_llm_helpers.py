"""Plain Python versions that several tests use."""

import re

from test_native import brute_base, brute_quality  # noqa: F401
from test_near_dedup import brute_classes  # noqa: F401
from test_windows import brute_contamination  # noqa: F401


def redacted(before, after):
    """``after`` is ``before`` with the base spans, and possibly more, replaced by marks."""
    if not brute_base(before) and before == after:
        return True
    parts = after.split("[SECRET]")
    pattern = r"[\s\S]+".join(map(re.escape, parts))
    return re.fullmatch(pattern, before) is not None and brute_base(after) == ""
