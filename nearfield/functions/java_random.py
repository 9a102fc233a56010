"""The generator that model parameters come from: the 48-bit linear congruential one of java.util.Random, as its
public specification has it, so that hashes agree with any index whose parameters come from the same seed."""

from __future__ import annotations

import math


class JavaRandom:
    def __init__(self, seed: int = 0):
        self._state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
        self._spare: float | None = None

    def _bits(self, n: int) -> int:
        self._state = (self._state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self._state >> (48 - n)

    def next_int(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return (bound * self._bits(31)) >> 31
        while True:
            bits = self._bits(31)
            value = bits % bound
            if bits - value + bound - 1 < 1 << 31:
                return value

    def next_float(self) -> float:
        return self._bits(24) / (1 << 24)

    def next_double(self) -> float:
        return ((self._bits(26) << 27) + self._bits(27)) / (1 << 53)

    def next_gaussian(self) -> float:
        """By the polar method, two at a time."""
        if self._spare is not None:
            out, self._spare = self._spare, None
            return out
        while True:
            x, y = 2 * self.next_double() - 1, 2 * self.next_double() - 1
            s = x * x + y * y
            if 0 < s < 1:
                scale = math.sqrt(-2 * math.log(s) / s)
                self._spare = y * scale
                return x * scale
