"""Words of texts as bytes, and stored tables; shared by the operators."""

from __future__ import annotations

import numpy as np
import xxhash

# bytes.split() cuts at \x20 and \x09-\x0D, and bytes.lower() lowers A-Z only: the words [^\x20\x09-\x0D]+.


def words_of(text: bytes | None, lower: bool) -> list[bytes]:
    if text is None:
        return []
    return (text.lower() if lower else text).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
