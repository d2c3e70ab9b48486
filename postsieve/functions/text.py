"""Text expressions: masks, hashes, URL and address parts.  All stay in the JVM.

Each pattern is kept with its RE2 twin for the SQL that checks it: Java needs (?U) for
Unicode classes, RE2 has no lookbehind and spells its classes out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

URL = r"""(?U)(?i)\b(?:https?://|www\.)[^\s<>"'()]+"""
ADDRESS = r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
DIGITS = r"(?U)\d+"
SPACE = r"(?U)\s+"
NUMBER = r"(?U)\b\d[\d,.\-]*\b"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)"
URL_SQL = r"""(?i)\b(?:https?://|www\.)[^\s<>"''()]+"""
ADDRESS_SQL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)+"
DIGITS_SQL = r"\p{Nd}+"

#: Fixed values.
TEXT_LIMIT, URL_LIMIT, HEAD_CHARS, CAPS_SAMPLE, SHORT_NORM = 200_000, 200, 2000, 20_000, 20


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _replaced(value: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
    """regexp_replace, but only where one of the strings occurs that every match holds."""

    def use(x: Column) -> Column:
        some = F.contains(x, F.lit(marks[0]))
        for m in marks[1:]:
            some = some | F.contains(x, F.lit(m))
        return F.when(some, F.regexp_replace(x, pattern, by)).otherwise(x)

    return once(value, use)


def normalized(subject: Column, text: Column) -> Column:
    """The text whose hash tells near-duplicates: lower case, then masks in this order."""
    s = F.lower(F.concat(subject, F.lit("\n"), text))
    s = _replaced(s, ("://", "www."), URL, " u ")
    s = _replaced(s, ("@",), ADDRESS, " e ")
    s = F.regexp_replace(s, DIGITS, "0")
    return F.trim(F.regexp_replace(s, SPACE, " "))


def norm_hash(subject: Column, text: Column, raw_sha256: Column) -> Column:
    return once(normalized(subject, text), lambda n: F.when(F.length(n) < SHORT_NORM, raw_sha256).otherwise(F.sha2(n, 256)))


def urls(text: Column) -> Column:
    """Distinct URLs in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(URL), 0)), 1, URL_LIMIT)


def url_domain(url: Column) -> Column:
    """Lower-case host without one leading www.; bracketed hosts give the empty string."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(F.contains(host, F.lit("[")), "").otherwise(F.regexp_replace(host, r"^www\.", ""))


def email_domain(address: Column) -> Column:
    return F.when(F.instr(address, "@") > 0, F.substring_index(address, "@", -1)).otherwise("")


def masked(text: Column) -> Column:
    """URLs, addresses and numbers as tokens, a URL's domain as one more; lower case last."""
    parts = F.split(text, URL, -1)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(URL), 0), lambda u: F.concat(F.lit(" __url__ urldom_"), F.regexp_replace(url_domain(u), "[^a-z0-9]", "_"), F.lit(" ")))
    joined = F.array_join(F.flatten(F.zip_with(parts, tokens, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    joined = F.regexp_replace(joined, ADDRESS, " __email__ ")
    return F.lower(F.regexp_replace(joined, NUMBER, " __num__ "))


def stripped(name: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def norm_folder(name: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(stripped(name), r"\\", "/"), "/"), -1)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(mbox|sbd)$", ""), SPACE, " ")))


def is_spam(label: Column) -> Column:
    return label.eqNullSafe(F.lit("spam")).cast("int")


def verdict(p: Column, flag: Column, move: Column) -> Column:
    return F.when(p >= move, "spam").when(p >= flag, "suspicious").otherwise("ham")


def split_enron(raw: Column) -> tuple[Column, Column]:
    """Subject and body of a header-less message: the first line if it begins with `subject:`."""
    text = F.regexp_replace(raw, "\r\n", "\n")
    first = F.substring_index(text, "\n", 1)
    has = F.lower(first).startswith("subject:")
    rest = F.when(F.instr(text, "\n") > 0, F.substring(text, F.length(first) + 2, F.lit(2**31 - 1))).otherwise("")
    return F.when(has, F.trim(F.substring(first, F.lit(9), F.lit(2**31 - 1)))).otherwise(""), F.when(has, rest).otherwise(text)


def gmail_labels(value: Column) -> Column:
    """The labels of a header value: comma-separated, quotes protect commas, blanks and empty ones go."""
    fields = F.regexp_extract_all(F.regexp_replace(F.coalesce(value, F.lit("")), "[\r\n]", ""), F.lit(r'\s*("(?:[^"]|"")*"|[^,]*)(?:,|$)'), 1)
    return F.filter(F.transform(fields, lambda x: F.trim(F.replace(F.regexp_replace(x, r'^"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"')))), lambda x: x != "")


def takeout_folder(labels: Column) -> Column:
    low = F.transform(labels, lambda x: F.lower(x))
    out = F.lit("Archived")
    for name in ("Inbox", "Sent", "Chat", "Drafts", "Trash", "Spam"):
        out = F.when(F.array_contains(low, name.lower()), name).otherwise(out)
    return out
