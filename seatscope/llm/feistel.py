"""Keyed permutations of the numbers below any bound, by an unbalanced Feistel network."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b
from math import isqrt

ROUNDS = 10


class Permutation:
    """A bijection on ``range(size)``; ``inside`` may restrict it to the numbers it accepts.

    The network works on pairs (x mod a, x div a) with a * b >= size. Values that leave the set are
    sent through again until they return, which they must, as the network itself is a bijection.
    """

    def __init__(self, key: bytes, kind: str, size: int, inside: Callable[[int], bool] | None = None) -> None:
        self._key, self._kind, self.size = key, kind.encode(), size
        self._a = isqrt(max(size - 1, 0)) + 1
        self._b = -(-size // self._a)
        # As wide as the half it is added to, and 16 bytes more, so that every remainder is as likely.
        self._noise_bytes = (self._a.bit_length() + 7) // 8 + 16
        self._inside = inside or (lambda _: True)

    def _noise(self, number: int, half: int) -> int:
        text = blake2b(b"%d|%x|%x|%s" % (number, self.size, half, self._kind), key=self._key)
        stream = b""
        while len(stream) < self._noise_bytes:
            part = text.copy()
            part.update(b"|%d" % len(stream))
            stream += part.digest()
        return int.from_bytes(stream[: self._noise_bytes])

    def _network(self, value: int, sign: int) -> int:
        right, left = divmod(value, self._a)
        for number in range(ROUNDS)[::sign]:
            if number % 2:
                right = (right + sign * self._noise(number, left)) % self._b
            else:
                left = (left + sign * self._noise(number, right)) % self._a
        return right * self._a + left

    def _walk(self, value: int, sign: int) -> int:
        if not (0 <= value < self.size and self._inside(value)):
            raise ValueError("The value is outside the permuted set")
        value = self._network(value, sign)
        while value >= self.size or not self._inside(value):
            value = self._network(value, sign)
        return value

    def __call__(self, value: int) -> int:
        return self._walk(value, 1)

    def inverse(self, value: int) -> int:
        return self._walk(value, -1)
