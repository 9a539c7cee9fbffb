"""Many terms searched in many texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 4
_SCATTER = np.uint32(0x9E3779B1)


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * _SCATTER) >> np.uint32(16)


class Terms:
    """Terms by their first four bytes, so that a text is gone over once for all of them."""

    def __init__(self, terms: Iterable[bytes]) -> None:
        self.starts: dict[int, dict[int, set[bytes]]] = {}  # by length
        self.short = []
        for term in dict.fromkeys(terms):
            if len(term) < GRAM:
                self.short.append(term)
            else:
                alike = self.starts.setdefault(int.from_bytes(term[:GRAM], "little"), {})
                alike.setdefault(len(term), set()).add(term)
        self.slots = np.zeros(1 << 16, bool)
        self.slots[_slots(np.array(list(self.starts), np.uint32))] = True

    def within(self, text: bytes) -> set[bytes]:
        """The terms that the text contains."""
        found = {t for t in self.short if t in text}
        if len(text) < GRAM or not self.starts:
            return found
        data = np.frombuffer(text, np.uint8).astype(np.uint32)
        codes = data[:-3] | (data[1:-2] << np.uint32(8)) | (data[2:-1] << np.uint32(16)) | (data[3:] << np.uint32(24))
        places = np.flatnonzero(self.slots[_slots(codes)])
        for at, code in zip(places.tolist(), codes[places].tolist(), strict=True):
            for size, terms in self.starts.get(code, {}).items():
                if (part := text[at:at + size]) in terms:
                    found.add(part)
        return found


_SEARCHED: list[tuple[dict, Terms]] = []  # the last broadcast that this worker searched for


def projects_in(projects: Broadcast) -> Callable[[Column], Column]:
    """The distinct projects (numbers, of broadcast lists by keyword) of which a text contains a keyword."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def found(text: pa.Array) -> pa.Array:
        if not _SEARCHED or _SEARCHED[0][0] is not projects.value:
            _SEARCHED[:] = [(projects.value, Terms(k.encode() for k in projects.value))]
        terms = _SEARCHED[0][1]
        texts = text.cast(pa.binary()).dictionary_encode()
        lists = [
            list(dict.fromkeys(p for k in sorted(terms.within(whole)) for p in projects.value[k.decode()]))
            for whole in texts.dictionary.to_pylist()
        ]
        return pa.array(lists, pa.list_(pa.int32())).take(texts.indices)

    return found


@F.arrow_udf(T.ArrayType(T.StringType()))
def contained(terms: pa.Array, text: pa.Array) -> pa.Array:
    """The terms that a text contains, in their order; none in a text that is null."""
    flat = terms.flatten().cast(pa.binary()).dictionary_encode()
    names = [*flat.dictionary.to_pylist(), None]
    codes = flat.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).tolist()
    known: dict[tuple, Terms] = {}
    out, at = [], 0
    for n, whole in zip(pc.list_value_length(terms).to_pylist(), text.cast(pa.binary()).to_pylist(), strict=True):
        if n is None:
            out.append(None)
            continue
        listed, at = tuple(codes[at:at + n]), at + n
        if whole is None or not n:
            out.append([])
            continue
        asked = [t for t in map(names.__getitem__, listed) if t is not None]
        if listed not in known:
            known[listed] = Terms(asked)
        found = known[listed].within(whole)
        out.append([t for t in asked if t in found])
    return pa.array(out, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
