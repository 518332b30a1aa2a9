"""Vectorised word and pre-token tables of text batches, for code that runs inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Any white space of Unicode, and what Python counts beside it.
_SPACE = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = "\x01"


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most_bytes` of text each; one longer text stands alone."""
    if not len(texts):
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + most_bytes, side="right")))
        yield start, stop
        start = stop


def filled(texts: pa.Array) -> pa.Array:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts, "")


def _table(lists: pa.ListArray, lengths: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    if keep is not None and not keep.all():
        ends = np.concatenate(([0], np.cumsum(keep)))[ends]
        codes = codes[keep]
    return codes, np.concatenate(([0], ends)).astype(np.int64), coded.dictionary.to_pylist()


def word_table(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between [\\x20\\x09-\\x0D]: their codes, where each text's words begin, and the distinct words (an empty one may stand unused)."""
    texts = filled(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return _table(lists, lengths, pc.greater(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False))


def chunk_table(texts: pa.Array, pattern) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Pieces of each text which `pattern` splits alone as it splits them within the text: codes, beginnings, distinct pieces.

    A text is cut before each single space between other characters than white
    space; there the pattern always starts a new match with that space. A text
    with white space beside a space is cut into its matches instead.
    """
    texts = filled(texts)
    odd = pc.match_substring_regex(texts, f"{_SPACE} | {_SPACE}|^ | $|{_CUT}").to_numpy(zero_copy_only=False)
    if not odd.any():
        lists = pc.split_pattern(pc.replace_substring(texts, " ", f"{_CUT} "), _CUT)
    else:
        plain = pc.split_pattern(pc.replace_substring(texts, " ", f"{_CUT} "), _CUT)
        rows = [pattern.findall(t) if o else None for t, o in zip(texts.to_pylist(), odd, strict=True)]
        lists = pc.if_else(pa.array(odd), pa.array(rows, pa.list_(pa.string())), plain)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return _table(lists, lengths, pc.greater(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
