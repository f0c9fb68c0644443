"""Bit-parallel edit distance: banded between two strings, and of a pattern inside a text."""

from __future__ import annotations


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both strings without their common beginning and end."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        low = high
    while high - low > 1:  # halves until the first difference
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    if low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    end, most = 0, min(len(a), len(b))
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    return (a[: len(a) - end], b[: len(b) - end]) if end else (a, b)


def within(a: str, b: str, k: int) -> int | None:
    """The edit distance of two strings if it is at most ``k``, else None.

    Of each column only the 2k + 1 rows around the diagonal are kept, as bits of two numbers (rises and falls between
    rows). The distance on the diagonal that ends in the last cell never falls, so the first excess ends the work.
    """
    a, b = trimmed(a, b)
    m, n = len(a), len(b)
    if abs(m - n) > k:
        return None
    if not m or not n:
        return max(m, n)
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    rise, fall = full & ~((1 << (k + 1)) - 1), 0
    bit, distance = m - n + k, abs(m - n)
    for j in range(1, n + 1):
        rise, fall = rise >> 1 | top, fall >> 1
        first = j - k - 1  # index in ``a`` of the window's lowest row
        equal = places.get(b[j - 1], 0)
        equal = (equal >> first if first >= 0 else equal << -first) & full
        same = ((((equal & rise) + rise) ^ rise) | equal | fall) & full
        up, down = fall | (full & ~(same | rise)), same & rise
        carried = (up << 1 | 1) & full
        rise, fall = (down << 1 | (full & ~(same | carried))) & full, carried & same
        if j > n - m and not same >> bit & 1:
            distance += 1
            if distance > k:
                return None
    return distance


def pattern_bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def find(places: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Smallest distance (if at most ``k``) of a pattern of ``m`` characters to a part of ``text``, and the first end of one.

    Myers' bit-parallel column: the pattern may begin anywhere in the text.
    """
    full, last = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        equal = places.get(c, 0)
        same = ((((equal & rise) + rise) ^ rise) | equal | fall) & full
        up, down = fall | (full & ~(same | rise)), same & rise
        score += 1 if up & last else -1 if down & last else 0
        carried = up << 1 & full
        rise, fall = (down << 1 | (full & ~(same | carried))) & full, carried & same
        if score < best:
            best, end = score, j
    return (best, end) if best <= k else None
