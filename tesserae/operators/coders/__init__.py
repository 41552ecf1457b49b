"""Tile coders. Each turns the integer indices of a square tile, row by row, into bytes and back.

They are the leaves of grouped DataFrame functions (see tiles.py): a tile is a row and no task holds more than its tiles.
"""

from __future__ import annotations

import numpy as np

from . import bitplane, huffman, rans, rice

#: name: (code of the container, encode(indices, size, levels), decode(bytes))
CODERS = {
    "rans": (0, rans.encode_shared, rans.decode_shared),
    "bitplane": (1, bitplane.encode, bitplane.decode),
    "rans_bands": (2, rans.encode_bands, rans.decode_bands),
    "rice": (3, rice.encode, rice.decode),
    "huffman": (4, huffman.encode, huffman.decode),
}


def choose(coder: str, per_band: bool, context: bool = False) -> str:
    """The coder that a configuration's names resolve to."""
    if coder == "rans":
        return "rans_context" if per_band and context else "rans_bands" if per_band else "rans"
    return coder


def zero_tile(coder: str, size: int, levels: int) -> bytes:
    """A tile of zeros, which stands in for a damaged one."""
    return CODERS[coder][1](np.zeros(size * size, np.int64), size, levels)
