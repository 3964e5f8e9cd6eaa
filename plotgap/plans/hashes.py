"""First words of many md5 sums at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Sums worked out at once: many for the cost of a call, few for a core's cache.
CHUNK = 1 << 15
_MASK = 0xFFFFFFFF
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_LEFT, _RIGHT = ([np.array(x, np.uint32) for x in turns] for turns in (_TURN, [32 - s for s in _TURN]))


def _plain(state: list[int], words: list[int], end: int) -> list[int]:
    """The first ``end`` steps of md5 on one block."""
    a, b, c, d = state
    for i in range(end):
        f = ((b & c) | (~b & d), (d & b) | (~d & c), b ^ c ^ d, c ^ (b | (~d & _MASK)))[i // 16]
        f = (f + a + _ADD[i] + words[_WORD[i]]) & _MASK
        a, b, c, d = d, (b + (f << _TURN[i] | f >> 32 - _TURN[i])) & _MASK, b, c
    return [a, b, c, d]


def _block(state: list, fixed: list[int], varied: dict[int, np.ndarray], size: int, last: bool) -> list[np.ndarray]:
    """md5's state after one more block of ``size`` texts; a word is its part in ``fixed`` plus, if any, that in ``varied``.

    ``last`` leaves out the three steps that the first word does not depend on, and all other words.
    """
    begin = 0 if isinstance(state[0], np.ndarray) else min(varied, default=16)  # until then the texts are the same
    a, b, c, d = (np.array(np.broadcast_to(np.asarray(x, np.uint32), size)) for x in (_plain(state, fixed, begin) if begin else state))
    t, left = np.empty(size, np.uint32), np.empty(size, np.uint32)
    xor, both, add = np.bitwise_xor, np.bitwise_and, np.add
    for i in range(begin, 61 if last else 64):
        if i < 16:
            xor(c, d, t), both(t, b, t), xor(t, d, t)
        elif i < 32:
            xor(b, c, t), both(t, d, t), xor(t, c, t)
        elif i < 48:
            xor(b, c, t), xor(t, d, t)
        else:
            np.invert(d, t), np.bitwise_or(t, b, t), xor(t, c, t)
        add(t, a, t), add(t, np.array((_ADD[i] + fixed[_WORD[i]]) & _MASK, np.uint32), t)
        if _WORD[i] in varied:
            add(t, varied[_WORD[i]], t)
        np.left_shift(t, _LEFT[i], left), np.right_shift(t, _RIGHT[i], t), np.bitwise_or(t, left, t), add(t, b, t)
        a, b, c, d, t = d, t, b, c, a
    return [x + np.asarray(y, np.uint32) for x, y in zip([b] if last else [a, b, c, d], state)]


def _digits(numbers: np.ndarray, length: int, at: int) -> dict[int, np.ndarray]:
    """The decimal digits of ``numbers``, all of ``length`` digits, in the words they take from byte ``at`` on."""
    words: dict[int, np.ndarray] = {}
    for k in range(at, at + length):
        digit = (numbers // 10 ** (at + length - 1 - k) % 10 + 48).astype(np.uint32) << np.uint32(8 * (k % 4))
        words[k // 4] = words[k // 4] + digit if k // 4 in words else digit
    return words


def _alike(first: int, last: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, digits): the numbers ``first`` to ``last`` in parts of at most ``most`` that have equally many digits."""
    while first <= last:
        digits = len(str(first))
        to = min(last, 10**digits - 1, first + most - 1)
        yield first, to, digits
        first = to + 1


def first_words(prefix: str, rows: tuple[int, int], columns: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, x) with x[a, b] the first eight hex digits of md5 of ``prefix|(i + a)|(j + b)``, as a number, for some j.

    ``rows`` and ``columns`` are the least and the largest number, above 0, of i and j. Every pair is in one x.
    """
    text = prefix.encode() + b"|"
    whole, state = len(text) // 64 * 64, _START
    for at in range(0, whole, 64):
        state = [(x + y) & _MASK for x, y in zip(_plain(state, np.frombuffer(text[at:at + 64], "<u4").tolist(), 64), state)]
    text = text[whole:]
    for j, j_to, j_digits in _alike(*columns, CHUNK):
        right: dict[int, dict[int, np.ndarray]] = {}
        for i, i_to, i_digits in _alike(*rows, max(1, CHUNK // (j_to - j + 1))):
            shape = (i_to - i + 1, j_to - j + 1)
            bar = len(text) + i_digits
            end = bar + 1 + j_digits
            frame = bytearray(-(-(end + 9) // 64) * 64)
            frame[:len(text)], frame[bar], frame[end] = text, ord("|"), 0x80
            frame[-8:] = (8 * (whole + end)).to_bytes(8, "little")
            if bar not in right:
                right[bar] = _digits(np.arange(j, j_to + 1), j_digits, bar + 1)
            varied = right[bar]
            if shape[0] == 1:
                frame[len(text):bar] = str(i).encode()
            else:
                left, none = _digits(np.arange(i, i_to + 1)[:, None], i_digits, len(text)), np.uint32(0)
                varied = {w: np.broadcast_to(left.get(w, none) + varied.get(w, none), shape).ravel() for w in {**left, **varied}}
            fixed, now = np.frombuffer(bytes(frame), "<u4").tolist(), state
            for at in range(0, len(fixed), 16):
                here = {w - at: x for w, x in varied.items() if at <= w < at + 16}
                now = _block(now, fixed[at:at + 16], here, shape[0] * shape[1], at + 16 == len(fixed))
            yield i, now[0].byteswap().reshape(shape)
