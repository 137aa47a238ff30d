"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, the share of tokens that are single
fallback bytes, and the entropy of the token distribution.  A text outside the bands of its language (or, for other
languages, of its script) is rejected, and so is one that fails the base rules on length and repetition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, utf8
from .tokenizing import piece_bpe

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words in repeated windows


@dataclass(frozen=True)
class Band:
    """Allowed ranges.  ``min_entropy`` is in bits per token, asked of texts with ``entropy_from`` tokens or more."""

    min_chars: float
    max_chars: float
    max_byte_share: float
    min_entropy: float
    entropy_from: int = 64


# Bands by language code, then by script.
LANGUAGES = {
    "en": Band(1.85, 8.0, 0.10, 4.5),
    "de": Band(1.85, 8.0, 0.10, 4.5),
    "fr": Band(1.65, 8.0, 0.10, 4.5),
    "es": Band(1.7, 8.0, 0.10, 4.5),
}
SCRIPTS = {
    "latin": Band(1.6, 9.0, 0.15, 4.0),
    "greek": Band(0.9, 6.0, 0.30, 3.5),
    "cyrillic": Band(1.2, 8.0, 0.20, 3.5),
    "hebrew": Band(0.7, 5.0, 0.40, 3.0),
    "arabic": Band(0.7, 5.0, 0.40, 3.0),
    "indic": Band(0.4, 5.0, 0.80, 2.5),
    "thai": Band(0.4, 5.0, 0.80, 2.5),
    "kana": Band(0.4, 3.0, 0.60, 3.5),
    "hangul": Band(0.3, 3.0, 0.80, 2.5),
    "han": Band(0.3, 3.0, 0.70, 3.5),
    "other": Band(0.2, 9.0, 1.00, 2.0),
}
# First code points of ranges, ascending, and the script that starts there.
STARTS = np.array([0x0, 0x41, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0xE80, 0x1100, 0x1200,
                   0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])
NAMES = ["other", "latin", "other", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "thai", "other",
         "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han",
         "other", "han"]
ORDER = list(SCRIPTS)
CODES = np.array([ORDER.index(n) for n in NAMES])


def script_of(text: str) -> str:
    """The script of most of the text's letters; "other" without letters.  Of equal counts the first in ``SCRIPTS``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = CODES[np.searchsorted(STARTS, points, side="right") - 1]
    ascii_letters = (points < 0x80) & (((points | 32) >= 97) & ((points | 32) <= 122))
    counts = np.bincount(codes[(points >= 0x80) | ascii_letters], minlength=len(ORDER))
    counts[ORDER.index("other")] = 0
    return ORDER[int(counts.argmax())] if counts.any() else "other"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(window):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:n + k]
    ordered = np.sort(total)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(total, twice))
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int((np.cumsum(steps) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words are ``[^\\x20\\x09-\\x0D]+``."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80))).translate(None, bytes(range(0xC0, 0x100))))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))


def measures(ids: np.ndarray, is_byte: np.ndarray, chars: int) -> tuple[float, float, float]:
    """Characters per token, share of fallback bytes, entropy in bits; zeros without tokens."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    counts = np.bincount(ids, minlength=len(is_byte))
    share = counts[counts > 0] / len(ids)
    return chars / len(ids), float(counts[is_byte].sum()) / len(ids), float(-(share * np.log2(share)).sum())


def verdict(band: Band, n_tokens: int, chars_per_token: float, byte_share: float, entropy: float) -> bool:
    return (band.min_chars <= chars_per_token <= band.max_chars and byte_share <= band.max_byte_share
            and (n_tokens < band.entropy_from or entropy >= band.min_entropy))


def fertility(docs: DataFrame, model: str) -> DataFrame:
    """Base counts, measures and verdict of every row of ``docs`` (doc_id, text, lang).  A null text has no words
    and fails; a null or unknown language is judged by its script."""

    def run(batch: pa.RecordBatch):
        coder = piece_bpe(model)
        rows = []
        for text, lang in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            base = base_counts(text)
            whole = text.decode()
            ids = np.frombuffer(coder.ids(whole), np.uint32)
            found = measures(ids, coder.is_byte, base[1])
            failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED * base[0]
            kind = lang if lang in LANGUAGES else script_of(whole)
            band = LANGUAGES.get(lang) or SCRIPTS[kind]
            rows.append((*base, failed, not failed and verdict(band, len(ids), *found), len(ids), *found, kind))
        return [batch.column(0), *map(list, zip(*rows))]

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    return by_arrow(named, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, "
                                "chars_per_token double, byte_share double, entropy double, band string")
