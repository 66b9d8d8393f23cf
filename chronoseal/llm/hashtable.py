"""Open-addressing hash table over 64-bit keys, built and read in whole arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_ODD = _U(0x9E3779B97F4A7C15)


def slots_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _ODD) >> _U(64 - bits)).astype(np.int64)


def place(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Put new, different keys into ``table``; returns their slots."""
    mask = (1 << bits) - 1
    slots = slots_of(keys, bits)
    waiting = np.arange(len(keys))
    while len(waiting):
        at = slots[waiting]
        free = table[at] == EMPTY
        _, first = np.unique(at[free], return_index=True)
        won = waiting[free][first]
        table[slots[won]] = keys[won]
        lost = np.ones(len(waiting), bool)
        lost[np.flatnonzero(free)[first]] = False
        waiting = waiting[lost]
        slots[waiting] = (slots[waiting] + 1) & mask
    return slots


def find(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Slots of keys; -1 where the table lacks the key."""
    mask = (1 << bits) - 1
    slots = slots_of(keys, bits)
    got = table[slots]
    odd = np.flatnonzero(got != keys)
    while len(odd):
        gone = got[odd] == EMPTY
        slots[odd[gone]] = -1
        odd = odd[~gone]
        slots[odd] = (slots[odd] + 1) & mask
        got[odd] = table[slots[odd]]
        odd = odd[got[odd] != keys[odd]]
    return slots


class HashMap:
    """Growing map from 64-bit keys to numbers."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 for unknown keys."""
        slots = find(self.keys, self.bits, keys)
        return np.where(slots >= 0, self.values[slots], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, different keys."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys != EMPTY
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self.bits, self.n = max(12, int(4 * len(keys)).bit_length()), 0
            self.keys, self.values = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.int64)
        self.values[place(self.keys, self.bits, keys)] = values
        self.n += len(keys)
