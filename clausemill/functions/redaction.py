"""Personal data, injected instructions and scans, as string columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels, words and sizes of the eight categories of personal data.
ACCOUNT_LABELS = (r"Account\s*#", r"\bA/?C\b", "Routing:", "Routing Number:", "ABA:", "ABA Routing:", "ACH:", "ACH Account:", "Bank Account:")
ACCOUNT_DIGITS = (8, 20)
CODE_LABELS = ("IBAN", "SWIFT", "BIC")
CODE_SIGNS = (4, 34)
HOUSE_DIGITS, STREET_SIGNS = (1, 6), 30
STREET_TYPES = ("Street", r"St\.?", "Avenue", r"Ave\.?", "Boulevard", r"Blvd\.?", "Drive", r"Dr\.?", "Lane", r"Ln\.?", "Road", r"Rd\.?", "Court", r"Ct\.?", "Place", r"Pl\.?", "Way", "Circle", r"Cir\.?", "Terrace", r"Ter\.?")
BIRTH_LABELS = ("DOB", r"D\.O\.B\.?", "Date of Birth", "Birthday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PARTIES = ("landlord", "tenant", "lessor", "lessee", "owner", "renter", "landlady", "landlord's? representative", "tenant's? representative", "co-tenant", "co-landlord", "agent")
NAME_WORDS = (1, 4)
GENERATIONS = (r"Jr\.?", r"Sr\.?", "II", "III", "IV")
# Names of the scan's rules, which it puts out, with the prefix, hexadecimal part and least length of keys and the shape of a variable's value.
KEYS = {"groq_api_key": ("gsk_", "", 16), "langfuse_public_key": ("pk-lf-", "[A-F0-9]{8}-", 4), "langfuse_secret_key": ("sk-lf-", "[A-F0-9]{8}-", 4)}
VARIABLES = {"langfuse_nextauth_secret": "[A-F0-9]{16,}", "langfuse_clickhouse_password": r"\S{4,}", "langfuse_minio_root_password": r"\S{4,}", "langfuse_redis_auth": r"\S{4,}"}
SECRET_ENDINGS = ("PASSWORD", "SECRET", "API_KEY")
SIGNED = ("/s/", "/Signature/", "Signed:?", "By:")


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


def _run(inner: str, ends: str, sizes: tuple[int, int]) -> str:
    """So many signs, of which the first and the last are of ``ends``."""
    return f"{ends}{inner}{{{sizes[0] - 2},{sizes[1] - 2}}}{ends}"


def _dates() -> str:
    """Dates by numbers, year last or first, and by the name of a month."""
    day, year, month = r"\d{1,2}", r"\d{2,4}", _any(MONTHS)
    return "(?:" + "|".join((rf"{day}[/-]{day}[/-]{year}", rf"\d{{4}}-{day}-{day}", rf"{month}\s+{day},?\s+{year}", rf"{day}\s+{month}\s+{year}")) + ")"


_WORD = r"\p{L}[\p{L}\p{M}'-]+"
#: A party's label and a name, without what must follow a name.
NAMED = rf"{_any(PARTIES)}\s*[:-]\s*{_WORD}(?:\s+{_WORD}){{{NAME_WORDS[0] - 1},{NAME_WORDS[1] - 1}}}(?:(?:,\s*|\s){_any(GENERATIONS)})?"
NAME_END = r"""[\s,;.!?:"'()\[\]]|$"""
#: Rules in the order in which they are applied, whatever the case.
PII_RULES = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b" + r"[\s-]?".join([r"\d{4}"] * 4) + r"\b",
    "account_number": rf"{_any(ACCOUNT_LABELS)}(?:\s+No\.?)?[\s-]*{_run(r'[\d\s-]', r'\d', ACCOUNT_DIGITS)}|\b{_any(CODE_LABELS)}\b:?\s*[A-Za-z0-9]{{{CODE_SIGNS[0]},{CODE_SIGNS[1]}}}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "street_address": rf"\b\d{{{HOUSE_DIGITS[0]},{HOUSE_DIGITS[1]}}}\s+[A-Za-z0-9][A-Za-z0-9.\s]{{0,{STREET_SIGNS}}}\s{_any(STREET_TYPES)}\b",
    "date_of_birth": rf"{_any(BIRTH_LABELS)}\s*(?:[:-]|is)?\s*{_dates()}|Born\s+\d{{4}}\b",
    "person_name": rf"{NAMED}(?={NAME_END})",
}
#: What a text must hold for a rule to match: a digit, a sign, or a pattern that is cheap to look for.  A rule without one runs always.
DIGIT, CODE, PARTY = "digit", "code", "party"
ANCHORS = {"ssn": (DIGIT,), "credit_card": (DIGIT,), "account_number": (DIGIT, CODE), "email": ("@",), "phone": (DIGIT,), "street_address": (DIGIT,), "date_of_birth": (DIGIT,), "person_name": (PARTY,)}
#: Phrases that try to steer a model.
INJECTIONS = (r"ignore\s+the\s+above", r"ignore\s+all\s+previous", r"system\s*:", r"user\s*:", r"forget\s+everything", r"disregard\s+all")
#: Rules for scans of files, line by line and whatever the case.
SCAN_RULES = {
    "ssn": PII_RULES["ssn"],
    "credit_card": PII_RULES["credit_card"],
    "account_number": r"\b(?:Account|Acct\.?|A/C)[:\s#]*[A-Z]{2}\d{8,12}\b",
    "signature": rf"^\s*{_any(SIGNED)}\s*[A-Z][a-zA-Z. -]{{2,60}}",
    **{name: rf"\b{prefix}{hexadecimal}[A-Za-z0-9{'_-' if hexadecimal else ''}]{{{least},}}\b" for name, (prefix, hexadecimal, least) in KEYS.items()},
    **{name: rf"^{name.upper()}\s*=\s*{value}\b" for name, value in VARIABLES.items()},
    "bearer_token": r"\bAuthorization\s*[:=]\s*Bearer\s+[A-Za-z0-9._-]{16,}\b",
    "password_assignment": rf"^[A-Z_][A-Z0-9_]*{_any(SECRET_ENDINGS)}\s*=\s*\S{{8,}}\b",
}
#: Any case; word edges, digits and white space are those of Unicode.
_FLAGS = "(?iU)"
#: What stands in a rule for edges, digits, white space and ends as SQL's patterns have them: of ASCII, whatever Java takes for them.
_WORD_SIGN = "[0-9A-Za-z_]"
_ASCII = {r"\b": f"(?:(?<={_WORD_SIGN})(?!{_WORD_SIGN})|(?<!{_WORD_SIGN})(?={_WORD_SIGN}))", r"\d": "[0-9]", r"\w": _WORD_SIGN, r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", "$": r"\z"}


def as_pattern(rule: str, ascii: bool = False) -> str:
    """A rule as a pattern for any case: with the edges, digits and blanks of Unicode, or of ASCII as in SQL, where the ``St`` of ``Stück`` is a word."""
    return "(?iu)" + re.sub(r"\\.|\$", lambda m: _ASCII.get(m[0], m[0]), rule) if ascii else _FLAGS + rule


def _can_match(text: Column, rule: str) -> Column:
    """Whether a text holds what the rule needs; no match is lost by skipping the rule where it does not."""
    looks = {
        DIGIT: lambda: text.rlike(r"\p{Nd}"),
        CODE: lambda: text.rlike(_FLAGS + _any(CODE_LABELS)),
        PARTY: lambda: (text.contains(":") | text.contains("-")) & text.rlike(rf"{_FLAGS}{_any(PARTIES)}\s*[:-]"),
    }
    out = F.lit(False)
    for anchor in ANCHORS[rule]:
        out = out | (looks[anchor]() if anchor in looks else text.contains(anchor))
    return out if ANCHORS[rule] else F.lit(True)


def redact_pii(text: Column | str, rules: Sequence[str] | None = None, ascii: bool = False) -> Column:
    """Every match of each rule in turn becomes its token.

    Only the rules whose anchors a text holds run on it.  A token brings no anchor
    of a later rule, so they are looked for once, in the text as it came.
    """
    text = F.col(text) if isinstance(text, str) else text
    chosen = [r for r in PII_RULES if rules is None or r in rules]

    def apply(out: Column, k: Column) -> Column:
        done = F.when(F.lit(False), out)
        for at, rule in enumerate(chosen):
            done = done.when(k == at, F.regexp_replace(out, as_pattern(PII_RULES[rule], ascii), f"[REDACTED_{rule.upper()}]"))
        return done

    due = F.array_compact(F.array(*(F.when(_can_match(text, rule), at) for at, rule in enumerate(chosen))))
    return F.aggregate(due, text, apply) if chosen else text


def _redacted(column: Column, kind: T.DataType, ascii: bool) -> Column:
    if isinstance(kind, T.StructType):
        inner = F.struct(*(_redacted(column[f.name], f.dataType, ascii).alias(f.name) for f in kind.fields))
        return F.when(column.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _redacted(x, kind.elementType, ascii))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: _redacted(v, kind.valueType, ascii))
    return redact_pii(column.cast("string"), ascii=ascii)


def redact_nested(df: DataFrame, ascii: bool = False) -> DataFrame:
    """All columns redacted inside structs, arrays and map values; nulls stay, scalars become text."""
    return df.select(*(_redacted(F.col(f"`{f.name}`"), f.dataType, ascii).alias(f.name) for f in df.schema.fields))


def pii_profile(df: DataFrame, key: str, text: str = "text", rules: Sequence[str] = tuple(PII_RULES), ascii: bool = False) -> DataFrame:
    """(key, category, hits), hits over 0; rules run where their anchors are."""
    counts = F.array(*(F.struct(F.lit(r).alias("category"), F.when(_can_match(F.col(text), r), F.size(F.regexp_extract_all(F.col(text), F.lit(as_pattern(PII_RULES[r], ascii)), F.lit(0)))).cast("long").alias("hits")) for r in rules))
    return df.select(key, F.inline(counts)).where("hits > 0")


def scan_lines(df: DataFrame, key: str, text: str = "text", rules: dict[str, str] | None = None, ascii: bool = False) -> DataFrame:
    """(key, line_no, rule, excerpt): lines with a finding; the excerpt is masked, stripped and cut to 80 characters."""
    from .text import strip

    rules = SCAN_RULES if rules is None else rules
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    found = F.array_compact(F.array(*(F.when(F.col("line").rlike(as_pattern(p, ascii)), r) for r, p in rules.items())))
    masked = F.col("line")
    for p in rules.values():
        masked = F.regexp_replace(masked, as_pattern(p, ascii), "[MASKED]")
    return lines.select(key, (F.col("i") + 1).alias("line_no"), F.explode(found).alias("rule"), F.substring(strip(masked), 1, 80).alias("excerpt"))


def scan_gate(findings: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, findings, clean) of every key of ``keys``, and in total (key null)."""
    counts = findings.groupBy(key).agg(F.count("*").alias("n"))
    rows = keys.select(key).distinct().join(counts, key, "left").rollup(key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    return rows.withColumn("clean", F.col("findings") == 0)


def flag_injection(text: Column | str, phrases: Sequence[str] = INJECTIONS) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike("(?i)" + "|".join(phrases)), F.lit(False))


def sanitize_chunk(text: Column | str, most: int = 2000, enabled: bool = True, phrases: Sequence[str] = INJECTIONS) -> Column:
    """Phrases deleted, then cut to ``most`` characters, then stripped."""
    from .text import strip

    out = F.col(text) if isinstance(text, str) else text
    for phrase in phrases if enabled else ():
        out = F.regexp_replace(out, "(?i)" + phrase, "")
    return strip(F.substring(out, 1, most))
