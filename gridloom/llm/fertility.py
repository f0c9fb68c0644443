"""Quality rules from tokeniser fertility, with rejection bands per language or script.

Public vocabularies measure each text: characters per token under a byte-level and a piece vocabulary, the share
of byte-fallback tokens, and the entropy of the piece tokens. Each distinct word of a batch is encoded once,
on its own. The bands are robust limits (median and quartile distances) over all documents of
a language; its band is blended with its script's, by the number of its documents.

Defined results: NULL and empty texts have zero words and fail the base rules; a text without tokens has NULL
measures and no verdict against it beyond the base rules; rows with the same or a NULL ``doc_id`` are measured
one by one; a NULL language uses the script; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import LETTER, Encoder, coded, flat, gathered, kept, mixed, pieces, rows_of, spans
from gridloom.llm.sizes import small
from gridloom.sources.workspace import cut

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

# First and last code point of each script's main block beyond ASCII; ASCII letters are Latin.
SCRIPTS = [
    ("Latin", 0xC0, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]

FEWEST_WORDS = 50
MEASURES = ["chars_per_byte_token", "chars_per_piece_token", "byte_share", "token_entropy"]
SCHEMA = (
    "doc_id bigint, lang string, script string, n_words bigint, word_chars bigint, n_symbols bigint,"
    " n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, "
    + ", ".join(f"{m} double" for m in MEASURES)
)


def summed(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def repeated_words(codes: np.ndarray, rows: np.ndarray, n: int, size: int = 3) -> np.ndarray:
    """Words inside windows of ``size`` words that occur twice or more in their row."""
    total = len(codes) - size + 1
    if total <= 0:
        return np.zeros(n, np.int64)
    whole = rows[:total] == rows[size - 1 :]
    at = np.flatnonzero(whole)
    columns = [rows[at], *(codes[at + k] for k in range(size))]
    key = np.zeros(len(at), np.uint64)
    for column in columns:
        key = mixed(key ^ column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    # equal hashes choose the windows, equal words decide
    spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    maybe = np.flatnonzero(twice[spot] == key)
    order = maybe[np.lexsort([c[maybe] for c in columns])]
    same = np.ones(len(order) - 1, bool)
    for column in columns:
        same &= column[order][1:] == column[order][:-1]
    found = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, found, 1)
    np.add.at(marks, found + size, -1)
    return summed(np.cumsum(marks[:-1]) > 0, rows, n)


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    n = len(offsets) - 1
    starts, ends = spans(data, offsets, data != 10)
    if not len(starts):
        return np.zeros(n, np.int64)
    rows = rows_of(starts, offsets)
    codes, distinct = coded(data, starts, ends)
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False)
    with_word = ~blank[codes]
    key = rows[with_word] * len(distinct) + codes[with_word]
    own = np.unique(key) // len(distinct)
    return np.bincount(rows[with_word], minlength=n) - np.bincount(own, minlength=n)


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script with most letters in each row, judged by the lead bytes of its characters."""
    n = len(offsets) - 1
    upto = np.concatenate(([0], np.cumsum(LETTER[data], dtype=np.int32)))
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xF0))
    first, second = data[lead].astype(np.int64), data[lead + 1].astype(np.int64) & 0x3F
    third = data[np.minimum(lead + 2, len(data) - 1)].astype(np.int64) & 0x3F
    point = np.where(first < 0xE0, (first & 0x1F) << 6 | second, (first & 0x0F) << 12 | second << 6 | third)
    rows = rows_of(lead, offsets)
    counts = np.stack(
        [np.bincount(rows[(point >= a) & (point <= b)], minlength=n) for _, a, b in SCRIPTS], axis=1
    ).reshape(n, len(SCRIPTS))
    counts[:, 0] += upto[offsets[1:]] - upto[offsets[:-1]]
    best = counts.argmax(axis=1)
    return [SCRIPTS[k][0] if counts[i, k] else "Other" for i, k in enumerate(best)]


def entropy(tokens: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Entropy in bits of the token ids of each row."""
    if not len(tokens):
        return np.zeros(n)
    key = np.sort(rows.astype(np.int64) << 32 | tokens)
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(edge, len(key)))
    row = key[edge] >> 32
    total = np.bincount(row, weights=count, minlength=n)
    share = count / total[row]
    return np.bincount(row, weights=-share * np.log2(share), minlength=n)


def measure(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """One row of counts and measures per document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        byte_level = Encoder(byte_vocabulary)
        piece_level = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        is_byte = np.array([piece_level.is_byte(i) for i in range(piece_level.get_piece_size())])
        known: dict[str, tuple[int, bytes]] = kept(f"words {byte_vocabulary} {piece_vocabulary}")
        for batch in pieces(batches, "text"):
            data, offsets = flat(batch.column("text"))
            n = len(offsets) - 1
            starts, ends = spans(data, offsets)
            rows = rows_of(starts, offsets)
            codes, distinct = coded(data, starts, ends)
            distinct = distinct.to_pylist()
            new = [w for w in distinct if w not in known]
            if len(known) + len(new) > Encoder.CACHE:
                known.clear()
                new = distinct
            plain = byte_level.tokenizer.encode_batch_fast([" " + w for w in new], add_special_tokens=False)
            for w, found, other in zip(new, plain, piece_level.encode(new, num_threads=1) if new else []):
                known[w] = (len(found.ids), array("I", other).tobytes())
            rated = [known[w] for w in distinct]
            sizes = np.array([len(r[1]) // 4 for r in rated], np.int64)
            first = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else sizes
            tokens, per_word = gathered(np.frombuffer(b"".join(r[1] for r in rated), "<u4"), first, sizes, codes)
            owner = np.repeat(rows, per_word)
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
            word_chars = summed(chars[ends] - chars[starts], rows, n)
            byte_tokens = summed(np.array([r[0] for r in rated], np.int64)[codes], rows, n)
            piece_tokens = np.bincount(owner, minlength=n)
            fallback = np.bincount(owner[is_byte[tokens]], minlength=n)
            upto = np.concatenate(([0], np.cumsum(SYMBOL[data], dtype=np.int32)))
            empty = piece_tokens == 0

            def ratio(a: np.ndarray, b: np.ndarray) -> pa.Array:
                return pa.array(a / np.maximum(b, 1), pa.float64(), mask=empty)

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("lang"),
                    pa.array(scripts(data, offsets), pa.string()),
                    *(
                        pa.array(v, pa.int64())
                        for v in (
                            np.bincount(rows, minlength=n),
                            word_chars,
                            upto[offsets[1:]] - upto[offsets[:-1]],
                            repeated_lines(data, offsets),
                            repeated_words(codes, rows, n),
                            piece_tokens,
                        )
                    ),
                    ratio(word_chars, byte_tokens),
                    ratio(word_chars, piece_tokens),
                    ratio(fallback, piece_tokens),
                    pa.array(entropy(tokens, owner, n), pa.float64(), mask=empty),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(run, SCHEMA)


def bands(measured: DataFrame, key: str, prefix: str) -> DataFrame:
    """Median of each measure per ``key`` and its deviation on either side, from all rated documents."""
    rated = measured.where(F.col(key).isNotNull() & (F.col("n_words") >= FEWEST_WORDS))
    wide = rated.groupBy(key).agg(
        F.count("*").alias(f"{prefix}_n"), *(F.percentile_approx(m, [0.25, 0.5, 0.75], 10000).alias(m) for m in MEASURES)
    )
    out = [F.col(key), F.col(f"{prefix}_n")]
    for m in MEASURES:
        low, mid, high = (F.col(m)[i] for i in range(3))
        # the distance to a quartile estimates the deviation; a uniform corpus gets a little width too
        least = F.lit(0.005) if m == "byte_share" else 0.01 * mid
        out += [
            mid.alias(f"{prefix}_mid_{m}"),
            F.greatest(1.4826 * (mid - low), least).alias(f"{prefix}_down_{m}"),
            F.greatest(1.4826 * (high - mid), least).alias(f"{prefix}_up_{m}"),
        ]
    return wide.select(*out)


def rules(
    docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, below: float = 3.5, above: float = 6.0,
    enough: int = 200, usual_words: int = 300,
) -> DataFrame:
    """Measures, base rules and verdict per document.

    ``kept`` is false if the base rules fail or a measure lies outside its band. A band reaches from ``below``
    deviations under the median to ``above`` over it; for texts of fewer than ``usual_words`` words it widens as the
    spread of a mean does. A language's band is blended with its script's by the number n of its documents, n to ``enough``, so a verdict
    changes little by little as a language fills.
    """
    measured = cut(measure(docs, byte_vocabulary, piece_vocabulary), "fertility")
    by_lang = cut(bands(measured, "lang", "_lang"), "bands")
    by_script = cut(bands(measured, "script", "_script"), "bands")
    joined = measured.join(small(by_lang), "lang", "left").join(small(by_script), "script", "left")
    own = F.coalesce(F.col("_lang_n") / (F.col("_lang_n") + enough), F.lit(0.0))
    spread = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(usual_words)) / F.greatest(F.col("n_words"), F.lit(1))))
    outside = F.lit(False)
    for m in MEASURES:
        mid, down, up = (
            F.coalesce(own * F.col(f"_lang_{x}_{m}") + (1 - own) * F.col(f"_script_{x}_{m}"), F.col(f"_script_{x}_{m}")) for x in ("mid", "down", "up")
        )
        off = F.col(m) - mid
        outside = outside | F.coalesce((off < -below * spread * down) | (off > above * spread * up), F.lit(False))
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~outside).alias("kept"), "lang", "script", "n_tokens", *MEASURES,
    )
