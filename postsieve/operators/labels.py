"""Labels from folder rules, and what a source holds by label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import norm_folder, stripped

#: Fixed values.
SENT = ["sent", "sent items", "sent mail", "sent messages"]
RULES = {
    "mbox": (["junk", "spam", "bulk", "bulk mail", "junk e-mail", "junk email"], ["trash", "deleted", "deleted items", "deleted messages", "drafts", "sent", "sent items", "sent mail", "sent messages", "templates", "outbox"], [], "ham"),
    "takeout": (["spam"], ["trash", "drafts", "chat", "sent"], [], "ham"),
    "eml": (["spam", "junk"], [], ["ham", "inbox", "not spam", "legit"], "skip"),
    "pst": (["junk email", "junk e-mail", "junk", "spam"], ["deleted items", "drafts", "outbox", "sent items", "sync issues", "conflicts", "local failures", "server failures", "calendar", "contacts", "tasks", "notes", "journal", "rss feeds", "conversation history"], [], "ham"),
}


@dataclass
class Overrides:
    label: str | None = None
    spam: list[str] = field(default_factory=list)
    ham: list[str] = field(default_factory=list)
    skip: list[str] = field(default_factory=list)
    include_sent: bool = False


def resolve(folder: Column, rules: str, own: Overrides | None = None) -> Column:
    """spam, ham or skip: a forced label, then the user's folders, sent mail, and the format's rules."""
    own = own or Overrides()
    if own.label:
        return F.lit(own.label)
    spam, skip, ham, default = RULES[rules]
    last, full = norm_folder(folder), F.lower(stripped(folder))
    named = lambda names: F.exists(F.array(last, full), lambda x: x.isin([n.strip().lower() for n in names]))
    out = F.when(named(own.spam), "spam").when(named(own.ham), "ham").when(named(own.skip), "skip")
    if own.include_sent:
        out = out.when(last.isin(SENT), "ham")
    for names, label in ((spam, "spam"), (skip, "skip"), (ham, "ham")):
        if names:
            out = out.when(last.isin(names), label)
    return out.otherwise(default)


def label_report(rows: DataFrame, rules: str, own: Overrides | None = None) -> DataFrame:
    """folder, count, label: counted before any parsing."""
    return rows.groupBy("folder").agg(F.count("*").alias("count")).withColumn("label", resolve(F.col("folder"), rules, own))


def totals(report: DataFrame) -> DataFrame:
    return report.groupBy("label").agg(F.sum("count").alias("count"))


def manifest_counts(mail: DataFrame) -> DataFrame:
    """label, folder, count, level: totals, per label, and per folder and label."""
    m = mail.select(F.coalesce("label", F.lit("unlabeled")).alias("label"), "folder")
    return m.rollup("label", "folder").agg(F.count("*").alias("count"), F.grouping_id().cast("long").alias("level"))
