"""String columns shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of Unicode, and the four separators of ASCII that count as such too.
BLANK = r"[\s\x1c-\x1f]"
#: A token of a lower-cased text.
TOKEN = "[a-z0-9§]+"


def strip(text: Column | str) -> Column:
    """Without white space at both ends, line ends and the blanks of Unicode included."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def squeezed(text: Column | str) -> Column:
    """Each run of white space made one space, none at the ends."""
    return strip(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of a-z, 0-9 and the section sign."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def hmac_sha256(text: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of the UTF-8 text, from two nested hashes."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pads = [F.unhex(F.lit(bytes(b ^ x for b in raw).hex())) for x in (0x36, 0x5C)]
    inner = F.sha2(F.concat(pads[0], F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(pads[1], F.unhex(inner)), 256)


def hash_query(text: Column | str, salt: str) -> Column:
    """First 16 hex digits of the HMAC of a question; the empty text stays empty."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(column == "", "").otherwise(F.substring(hmac_sha256(column, salt), 1, 16))
