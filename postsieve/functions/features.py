"""Structural and header features of mail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import CAPS_SAMPLE, HEAD_CHARS, email_domain, masked, once, url_domain

#: Fixed values.
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "tiny.cc", "rb.gy", "shorturl.at"]
RISKY = ["exe", "scr", "js", "vbs", "bat", "cmd", "com", "jar", "html", "htm", "zip", "rar", "7z", "iso", "img", "docm", "xlsm", "lnk", "hta"]
IP_URL = r"^(?:https?://)?\d{1,3}(?:\.\d{1,3}){3}(?:[:/]|$)"
STRUCTURAL = ["url_count", "url_domains", "html_share", "n_attachments", "risky_attachment", "reply_to_mismatch", "caps_ratio", "exclaim_per_1k", "dollar_per_1k", "log_length", "ip_url", "shortener_url", "has_headers"]


def structural(m: DataFrame) -> list[Column]:
    """The 13 features as doubles, named as in STRUCTURAL."""
    c = m.__getitem__
    text = F.coalesce(c("text"), F.lit(""))
    sample = F.substring(text, 1, CAPS_SAMPLE)
    # what is left without other characters is measured: a count of matches makes a string of each
    only = lambda x, kind: F.regexp_replace(x, rf"\P{{{kind}}}+", "")
    caps = once(only(sample, "L"), lambda x: F.when(F.length(x) > 0, F.length(only(x, "Lu")) / F.length(x)).otherwise(0.0))
    domains = F.array_except(F.array_distinct(F.transform(c("urls"), url_domain)), F.array(F.lit("")))
    own, reply = email_domain(c("from_addr")), email_domain(c("reply_to"))
    per_1k = lambda mark: 1000.0 * (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.greatest(F.length(text), F.lit(1))
    values = [
        F.size(c("urls")), F.size(domains), c("html_share"), c("n_attachments"),
        F.arrays_overlap(F.transform(c("attachment_types"), lambda x: F.lower(x)), F.array(*map(F.lit, RISKY))),
        (own != "") & (reply != "") & (own != reply),
        caps, per_1k("!"), per_1k("$"), F.log1p(F.length(text)),
        F.exists(c("urls"), lambda u: u.rlike(IP_URL)),
        F.arrays_overlap(domains, F.array(*map(F.lit, SHORTENERS))),
        c("from_addr") != "",
    ]
    return [F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for v, n in zip(values, STRUCTURAL, strict=True)]


def header_tokens(headers: Column, from_addr: Column, reply_to: Column) -> Column:
    """fromdom=, replydom=, mailer=, ctype=, has_list_unsub in this order; no_headers if none."""
    get = lambda k: F.nullif(F.try_element_at(headers, F.lit(k)), F.lit(""))
    domain = lambda a: F.nullif(email_domain(a), F.lit(""))
    mailer = F.lower(F.regexp_extract(F.coalesce(get("x-mailer"), get("user-agent"), F.lit("")), r"^\s*([A-Za-z][A-Za-z0-9._-]*)", 1))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(get("content-type"), F.lit("")), ";", 1)))
    parts = [
        F.concat(F.lit("fromdom="), domain(from_addr)), F.concat(F.lit("replydom="), domain(reply_to)),
        F.when(mailer != "", F.concat(F.lit("mailer="), mailer)), F.when(kind != "", F.concat(F.lit("ctype="), kind)),
        F.when(F.map_contains_key(headers, F.lit("list-unsubscribe")), "has_list_unsub"),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("no_headers"))


def feature_frame(m: DataFrame) -> DataFrame:
    head = F.concat(m["subject"], F.lit("\n"), F.substring(m["text"], 1, HEAD_CHARS))
    return m.select("seq", "label", masked(m["subject"]).alias("subject_tokens"), masked(m["text"]).alias("body_tokens"), head.alias("head"), header_tokens(m["headers"], m["from_addr"], m["reply_to"]).alias("hdr"), *structural(m))
