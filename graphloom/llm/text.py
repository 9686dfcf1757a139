"""Words of texts: as SQL columns, and as integer codes of Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words in all contracts: the six ASCII characters.
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, also where body names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def coded(texts, lower: bool):
    """(offsets, codes, uniques) of a pyarrow string array: text i has the words uniques[codes[offsets[i]:offsets[i+1]]].

    Splits at the six ASCII white-space characters; lower folds A-Z only. Nulls have no words.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    # a copy, as Arrow's string functions misplace the offsets of a slice
    texts = texts.take(pa.array(np.arange(len(texts))))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    uniques = flat.dictionary.to_pylist()
    keep = codes != uniques.index("") if "" in uniques else np.ones(len(codes), bool)
    before = np.concatenate(([0], np.cumsum(keep)))
    return before[offsets], codes[keep], uniques


def release() -> None:
    """Hand memory that this worker process has freed back to the system: workers stay between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def batch_arrays(batches, *names, part_bytes: int = 8 << 20):
    """The named columns of Arrow batches, in parts of some `part_bytes`: what is built for a part stays small."""
    for batch in batches:
        step = max(1, batch.num_rows // (batch.nbytes // part_bytes + 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [part.column(part.schema.get_field_index(n)) for n in names]
    release()
