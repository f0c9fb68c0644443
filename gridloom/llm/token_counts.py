"""Token counts per field and section of a document, by the character spans of its tokens.

The fields of a row are joined by a newline and encoded once, as a whole; the last field is cut into sections at
its newlines. Token spans and section spans are joined as intervals by binary search. A token that touches one section
belongs to it. A token that touches several is allocated by ``rule``: ``first`` gives it to the section of its first
character, ``most`` to the one it covers most of (the earlier of equals). A token that touches none (a newline by itself, say) belongs to
the section before it. So the counts of a document's sections add up to its tokens, whatever the rule.

Defined results: a NULL field is empty; an empty field or section is listed with no token of its own; rows that repeat a
``doc_id`` or have NULL are counted one by one; an empty table gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import Encoder, flat, pieces, rows_of

COUNTS = "doc_id bigint, field string, section int, begin bigint, length bigint, n_tokens bigint, n_crossing bigint"


def attribute(
    token_row: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, begin: np.ndarray, behind: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it touches several. Sections are ordered by row and place and cover every row's first character."""
    # one number line for all rows
    width = int(max(end.max(initial=0), behind.max(initial=0))) + 1
    low, high = row * width + begin, row * width + behind
    a, b = token_row * width + start, token_row * width + np.maximum(end, start + 1) - 1
    owner = np.searchsorted(low, a, "right") - 1  # for tokens that touch no section: the last that begins up to there
    full = np.flatnonzero(high > low)
    if not len(full):
        return owner, np.zeros(len(owner), bool)
    at, to = low[full], high[full]
    first = np.searchsorted(at, a, "right") - 1
    first = np.where((first < 0) | (a >= to[first]), first + 1, first)  # the first full section with a character from there on
    last = np.searchsorted(at, b, "right") - 1
    touched = first <= last
    crossing = first < last
    owner[touched] = full[first[touched]]
    if rule == "most":
        for t in np.flatnonzero(crossing):
            parts = np.arange(first[t], last[t] + 1)
            covered = np.minimum(to[parts], b[t] + 1) - np.maximum(at[parts], a[t])
            owner[t] = full[parts[np.argmax(covered)]]
    return owner, crossing


def sections(lengths: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, field, number, begin and end (in characters) of each section of joined fields.

    ``lengths`` has the characters of every field but the last, per row.
    """
    n = len(offsets) - 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    total = chars[offsets[1:]] - chars[offsets[:-1]]
    before = np.zeros(n, np.int64)
    row, field, number, begin, behind = [], [], [], [], []
    for k, length in enumerate(lengths):
        row.append(np.arange(n))
        field.append(np.full(n, k))
        number.append(np.zeros(n, np.int64))
        begin.append(before)
        behind.append(before + length)
        before = before + length + 1
    breaks = np.flatnonzero(data == 10)
    owner = rows_of(breaks, offsets)
    place = chars[breaks] - chars[offsets[owner]]
    inside = place >= before[owner]
    owner, place = owner[inside], place[inside]
    r = np.concatenate((np.arange(n), owner))
    b = np.concatenate((before, place + 1))
    order = np.lexsort((b, r))
    r, b = r[order], b[order]
    last = np.append(r[1:] != r[:-1], True) if len(r) else np.zeros(0, bool)
    e = np.where(last, total[r], np.append(b[1:], 0) - 1)
    row.append(r)
    field.append(np.full(len(r), len(lengths)))
    number.append(np.arange(len(r)) - np.searchsorted(r, r))
    begin.append(b)
    behind.append(e)
    all_of = [np.concatenate(x) for x in (row, field, number, begin, behind)]
    order = np.lexsort((all_of[3], all_of[0]))
    return tuple(x[order] for x in all_of)


def count(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("text",), rule: str = "most") -> DataFrame:
    """One row per document row, field and section: ``begin`` and ``length`` in characters, tokens allocated to it, and how
    many of these also touch another section."""
    if rule not in ("first", "most"):
        raise ValueError("rule is 'first' or 'most'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in pieces(batches, f"f{len(fields) - 1}"):
            columns = [pc.fill_null(batch.column(f"f{k}"), "") for k in range(len(fields))]
            joined = pc.binary_join_element_wise(*columns, "\n") if len(columns) > 1 else columns[0]
            lengths = [pc.utf8_length(c).to_numpy().astype(np.int64) for c in columns[:-1]]
            data, offsets = flat(joined)
            row, field, number, begin, behind = sections(lengths, data, offsets)
            _, token_rows, start, end = encoder(joined, with_spans=True)
            token_row = np.repeat(np.arange(len(batch)), np.diff(token_rows))
            owner, crossing = attribute(token_row, start.astype(np.int64), end.astype(np.int64), row, begin, behind, rule)
            names = pa.DictionaryArray.from_arrays(pa.array(field, pa.int32()), pa.array(fields)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    names,
                    pa.array(number, pa.int32()),
                    pa.array(begin, pa.int64()),
                    pa.array(behind - begin, pa.int64()),
                    pa.array(np.bincount(owner, minlength=len(row)), pa.int64()),
                    pa.array(np.bincount(owner[crossing], minlength=len(row)), pa.int64()),
                ],
                names=[c.split()[0] for c in COUNTS.split(", ")],
            )

    chosen = [F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *chosen).mapInArrow(run, COUNTS)
