"""Text normalisation, tokens and digests."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpulse.functions.cleaning import as_column

# Latin letters that have no canonical decomposition, and the plain letters that stand for them.
WHOLE_LETTERS = "łŁøØđĐħĦŧŦıĿŀ"
WHOLE_PLAIN = "lLoOdDhHtTiLl"


def _decomposed() -> tuple[str, str]:
    """Accented Latin letters and their plain letters, position by position, from the canonical decompositions."""
    accented, plain = [], []
    for point in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            accented.append(chr(point))
            plain.append(base[0])
    return "".join(accented) + WHOLE_LETTERS, "".join(plain) + WHOLE_PLAIN


ACCENTED, PLAIN = _decomposed()

# Words left out of token sets.
STOP_WORDS = (
    "para", "por", "con", "sin", "del", "las", "los", "una", "uno", "que", "como", "sobre", "esta", "este",
    "estos", "estas", "entre", "desde", "hacia", "cual", "cuales", "estado", "evento", "elemento",
)


def plain_text(value: Column | str) -> Column:
    """Lower case, accents removed (combining marks included), other signs turned into single spaces."""
    text = F.translate(F.lower(F.coalesce(as_column(value).cast("string"), F.lit(""))), ACCENTED, PLAIN)
    text = F.regexp_replace(text, "\\p{Mn}+", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9_./:-]+", " "))


def tokens(value: Column | str, stop_words: Sequence[str] = STOP_WORDS, shortest: int = 3) -> Column:
    """Distinct tokens of at least ``shortest`` characters, stop words left out."""
    words = F.array_distinct(F.split(plain_text(value), " "))
    words = F.filter(words, lambda w: F.length(w) >= shortest)
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words]))


def short_hash(*parts: Column | str, length: int = 16) -> Column:
    """Leading hex digits of SHA-256 over the parts joined by a bar; null counts as empty."""
    texts = [F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, length)


def generated_id(existing: Column | str, prefix: str, **fields: Column | str) -> Column:
    """Existing id, or ``prefix-`` plus 16 hex of SHA-1 over the JSON of the fields in key order."""
    record = F.struct(
        *[F.trim(F.coalesce(as_column(fields[k]).cast("string"), F.lit(""))).alias(k) for k in sorted(fields)]
    )
    made = F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.to_json(record)), 1, 16))
    present = F.nullif(F.trim(as_column(existing).cast("string")), F.lit(""))
    return F.coalesce(present, made)


def slug(value: Column | str) -> Column:
    """Lower-case slug with single dashes."""
    return F.regexp_replace(F.regexp_replace(plain_text(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_excluded(value: Column | str, fragments: Sequence[str]) -> Column:
    """True where the lower-cased name contains one of the fragments."""
    name = F.lower(as_column(value))
    test = F.lit(False)
    for fragment in fragments:
        test = test | F.contains(name, F.lit(fragment.lower()))
    return test
