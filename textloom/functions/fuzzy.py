"""Fuzzy string likeness by indel distance, and the intent of a message. Python, a batch of messages at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from textloom.functions import dictionaries as d
from textloom.functions.rows import by_row


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, over bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter with a stretch of its length in the longer, stretches cut off at the ends included.

    A result below ``least`` may be anything below it. A stretch has no more in common with the shorter string than a longer
    one around it, so most of a long text is passed over in steps of the shorter string's length."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), least - 1e-9
    for start in range(1 - n, len(b), n):
        around = b[max(0, start) : start + 2 * n - 1]
        shortest = min(n, n + start if start < 0 else n, len(b) - min(len(b) - 1, start + n - 1))
        if 200.0 * min(n, common(a, around)) / (n + shortest) > best:
            best = max(best, *(ratio(a, b[max(0, i) : i + n]) for i in range(start, min(start + n, len(b)))))
    return max(best, 0.0)


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_set(a: str, b: str, score=ratio) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    return max(score(both, one) if both else 0, score(both, two) if both else 0, score(one, two))


def weighted_ratio(a: str, b: str) -> float:
    """Of several likenesses the best, those on parts and on sorted words at a discount."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * ratio(_sorted(a), _sorted(b)), 0.95 * token_set(a, b))
    part = 0.9 if longer < 8 else 0.6
    return max(best, part * partial_ratio(a, b), 0.95 * part * partial_ratio(_sorted(a), _sorted(b)), 0.95 * part * token_set(a, b, partial_ratio))


def processed(s: str) -> str:
    """As strings are compared: lower case, blanks for all but letters and digits, none at the ends."""
    return re.sub(r"\W", " ", s).lower().strip()


_GREETINGS, _CONFIRMS, _NONSENSE = ([processed(w) for w in words] for words in (d.GREETINGS, d.CONFIRMS, d.NONSENSE))


def intent_of(message: str) -> str:
    """UNKNOWN (a question), GREETING, CONFIRM or NONSENSE of a message whose accents are folded."""
    if any(h in message for h in d.QUESTION_HINTS):
        return "UNKNOWN"
    if len(message.strip()) <= 1:
        return "NONSENSE"
    said = processed(message)

    def best(score: Callable[[str, str], float], words: list[str], longest: float) -> int:
        """The best of the scores that may count; beyond ``longest`` times the other's length none comes near 80."""
        near = [p for p in words if p and max(len(p), len(said)) <= longest * min(len(p), len(said))]
        return round(max((score(said, p) for p in near), default=0))

    greeting, nonsense = best(weighted_ratio, _GREETINGS, 8), best(weighted_ratio, _NONSENSE, 8)
    confirm = best(ratio, _CONFIRMS, 1.6)
    if greeting >= max(80, confirm, nonsense):
        return "GREETING"
    if confirm >= max(80, nonsense):
        return "CONFIRM"
    return "NONSENSE" if nonsense >= 85 or re.fullmatch(r"[\W\d\s]+", message) else "UNKNOWN"


@by_row(StringType())
def intent(message: str | None) -> str:
    return intent_of(message or "")


@F.pandas_udf(DoubleType())
def partial_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _shared(text: str, names: list[str]) -> Callable[[str], np.ndarray]:
    """Of a name no longer than the text, the ratio that none of its stretches (as in ``partial_ratio``, in order) exceeds:
    letters in common, wherever they stand. The counts of letters up to each place are made once for all names."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = {c: i for i, c in enumerate(sorted(set("".join(names))))}
    size, wide = len(text), max(map(len, names))
    upto = np.zeros((len(letters), size + 2 * wide + 1), np.int16 if size < 1 << 15 else np.int32)  # of the text with room around it
    np.cumsum(codes == np.array([[ord(c)] for c in letters], np.uint32), axis=1, out=upto[:, wide + 1 : wide + size + 1])
    upto[:, wide + size + 1 :] = upto[:, wide + size : wide + size + 1]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bound(name: str) -> np.ndarray:
        n = len(name)
        if n not in held:
            start = np.arange(1 - n, size)
            lo, hi = np.maximum(start, 0), np.minimum(start + n, size)
            held[n] = upto[:, wide + 1 : wide + size + n] - upto[:, wide + 1 - n : wide + size], n + hi - lo
        inside, both = held[n]
        own = sorted(set(name))
        most = np.minimum(inside[[letters[c] for c in own]], np.array([[name.count(c)] for c in own], upto.dtype)).sum(0)
        return 200.0 * most / both

    return bound


def nearest(text: str, names: list[str], least: float = 70) -> str:
    """The name most like a part of the text, the first in order of equals; '' if none reaches ``least``."""
    score, name = least, ""
    bound = _shared(text, names) if text else None

    def like_of(n: str) -> float:
        if not 0 < len(n) < len(text):
            return partial_ratio(text, n, score)
        best, may = score - 1e-9, bound(n)
        at = np.flatnonzero(may > best)
        for i in at[np.argsort(-may[at])].tolist():
            if may[i] <= best:
                break
            lo = i + 1 - len(n)
            best = max(best, ratio(n, text[max(0, lo) : lo + len(n)]))
        return max(best, 0.0)

    for n in sorted(names):
        if (like := like_of(n)) >= score and (like > score or not name):
            score, name = like, n
    return name


PROGRAM_NAMES = sorted({v for _, v in d.PROGRAMS})


@by_row(StringType())
def nearest_program(question: str | None) -> str:
    return nearest((question or "").lower(), PROGRAM_NAMES)
