"""Signals in English-language web text: the same engine with another vocabulary."""

from factsieve.packs.model import Criterion, RulePack, Topic

TOPICS = (
    Topic("01", "contact", "contact details", (
        Criterion("01-a", "mail address", "C", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.example\.(com|net|org)", needs=(".example.",)),
        Criterion("01-b", "telephone number", "D", r"\+1 \(\d{3}\) \d{3}-\d{4}", needs=("+1 (",)),
    ), core=r"@"),
    Topic("02", "card", "payment card", (
        Criterion("02-a", "card number", "C", r"(^|[^0-9])[0-9]{16}([^0-9]|$)"),
    ), core=r"\d{4}"),
    Topic("03", "network", "network address", (
        Criterion("03-a", "address", "C", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", needs=(".",)),
    ), core=r"\d+\.\d+"),
    Topic("04", "credential", "credential", (
        Criterion("04-a", "token", "C", r"token = ", needs=("token = ",)),
        Criterion("04-b", "value", "D", r"\"[0-9a-f]{40}\"", needs=("\"",)),
    ), core=r"token"),
    Topic("05", "licence", "licence", (
        Criterion("05-a", "named licence", "C", r"(Apache License|MIT License)", needs=("Apache License", "MIT License")),
        Criterion("05-b", "version", "D", r"Version \d+\.\d+", needs=("Version ",)),
    ), core=r"[Ll]icen[sc]e"),
    Topic("06", "boilerplate", "boilerplate", (
        Criterion("06-a", "rights", "C", r"[Aa]ll rights reserved", needs=("ll rights reserved",)),
    ), core=r"rights"),
    Topic("07", "statement", "statement", (
        Criterion("07-a", "linking word", "C", r"(^|[^A-Za-z])(with|from|that|which)([^A-Za-z]|$)", needs=("with", "from", "that", "which")),
    ), core=r"with"),
)

PACK = RulePack(
    name="signals_en",
    topics=TOPICS,
    undecided=r"(\(|\||maybe)",
    external=r"(Version|under)",
    negated=r"(^|[^A-Za-z])(not|no|without)([^A-Za-z]|$)",
    negation_status={"07-a": ("PARTIAL", None)},
)
