"""Rule extraction: which lines speak about which criterion, and how.

Each criterion names the words that its pattern needs. One automaton finds the words of all criteria in all lines (``functions.literals``), and
a pattern is tried only where one of its words stands, once per distinct line of a batch (``functions.rules``): ``hits`` is a sparse, ordered list
per document, and what a document does not speak of costs nothing. First hits need no ranking window, as the list is ordered by criterion and line.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve import schemas
from factsieve.functions.arrays import let, unnest
from factsieve.functions.reuse import reused
from factsieve.functions.rules import hits, line_rules
from factsieve.functions.text import compiled, extract_all, matches, norm_ws
from factsieve.packs import korean as K
from factsieve.packs.model import RulePack

HIT = pa.struct([("criterion_id", pa.string()), ("line_no", pa.int32()), ("text", pa.string())])
SPOKEN = pa.struct([("criterion_id", pa.string()), ("finding", pa.string()), ("line_no", pa.int32()), ("text", pa.string()), ("term_type", pa.string())])

def match_lines(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Adds ``hits``: array<struct<criterion_id,line_no,text>>, the matching lines of all criteria, in the order of the pack and of the lines."""
    rules, ids = line_rules(pack), pa.array(pack.criterion_ids, pa.string())

    @F.arrow_udf("array<struct<criterion_id:string,line_no:int,text:string>>")
    def find(lists: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(HIT))]
        for n, texts, doc, rule, line, text in hits(lists, rules):
            found = pa.StructArray.from_arrays([ids.take(pa.array(rule)), pa.array(line + 1, pa.int32()), texts.take(pa.array(text))], fields=list(HIT))
            parts.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), found))
        return pa.concat_arrays(parts)

    # not to be repeated or moved into an aggregate by the optimizer
    return docs.withColumn("hits", find.asNondeterministic()(F.col("lines")["text"]))


def hit_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All hits as rows (document, criterion, line)."""
    return unnest(docs, "hits", key, present="line_no")


def first_hits(docs: DataFrame, k: int = 2) -> DataFrame:
    """Keep the first ``k`` lines per criterion."""

    def first(hits: Column) -> Column:
        return F.filter(hits, lambda h, i: (i < k) | (F.get(hits, i - k)["criterion_id"] != h["criterion_id"]))

    return docs.withColumn("hits", let(F.col("hits"), first))


def classify_finding(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Adds ``claims``: one claim per criterion of the pack, absent ones included."""
    negatable = list(pack.negation_status)
    none = F.lit(None).cast("string")
    rest = [none.alias("source_value"), none.alias("term_type"), none.alias("value_kind"), F.lit(None).cast(schemas.CALC).alias("calc")]
    no_quotes = F.array().cast(f"array<{schemas.QUOTE}>")
    ids = F.array(*[F.lit(i) for i in pack.criterion_ids])

    def absent(cid: Column) -> Column:
        return F.struct(cid.alias("criterion_id"), F.lit("absent").alias("finding"), no_quotes.alias("quotes"), *rest)

    def claim(cid: Column, first: Column, text: Column) -> Column:
        kind = F.when(cid.isin(negatable) & matches(text, pack.negated), "negated") if negatable else F.when(F.lit(False), "negated")
        kind = kind.when(matches(text, pack.undecided), "undecided").when(matches(text, pack.external), "coarse")
        if pack.hours_id:
            kind = kind.when((cid == pack.hours_id) & ~matches(text, pack.hours), "coarse")

        def told(finding: Column) -> Column:
            specific = finding == "specific"
            term = (F.when(specific & (cid == pack.fixed_term_id), F.when(matches(text, pack.indefinite), "indefinite").otherwise("fixed"))
                    if pack.fixed_term_id else none)
            value_kind = F.when(specific & (cid == pack.hours_id), "quoted") if pack.hours_id else none
            quote = F.struct(first["line_no"].alias("line"), first["text"].alias("text"))
            return F.struct(cid.alias("criterion_id"), finding.alias("finding"), F.array(quote).alias("quotes"), none.alias("source_value"),
                            term.alias("term_type"), value_kind.alias("value_kind"), F.lit(None).cast(schemas.CALC).alias("calc"))

        return let(kind.otherwise("specific"), told)

    def of_group(g: Column) -> Column:
        return let(F.array_join(F.transform(g["found"], lambda h: h["text"]), " "), lambda text: claim(g["id"], F.get(g["found"], F.lit(0)), text))

    def spoken(hits: Column) -> Column:
        heads = F.filter(hits, lambda h, i: (i == 0) | (F.get(hits, i - 1)["criterion_id"] != h["criterion_id"]))
        groups = F.transform(heads, lambda h: F.struct(
            h["criterion_id"].alias("id"), F.filter(hits, lambda x: x["criterion_id"] == h["criterion_id"]).alias("found")))
        return F.transform(groups, of_group)

    def all_claims(claims: Column) -> Column:
        mine = lambda i: F.get(F.filter(claims, lambda c: c["criterion_id"] == i), F.lit(0))
        return F.transform(ids, lambda i: F.coalesce(mine(i), absent(i)))

    build = lambda: let(let(F.col("hits"), spoken), all_claims)
    return docs.withColumn("claims", reused(("claims", pack.digest), build)).drop("hits")


def findings_of(pack: RulePack):
    """(finding, term type) that a text gives a criterion, as in ``classify_finding``."""
    ids, negatable, hours_id, fixed_term_id = pack.criterion_ids, frozenset(pack.negation_status), pack.hours_id, pack.fixed_term_id
    negated, undecided, external, hours, indefinite = pack.negated, pack.undecided, pack.external, pack.hours, pack.indefinite

    def told(rule: int, text: str) -> tuple[str, str | None]:
        cid, says = ids[rule], lambda pattern: compiled(pattern).search(text)
        if cid in negatable and says(negated):
            return "negated", None
        if says(undecided):
            return "undecided", None
        if says(external) or (hours_id and cid == hours_id and not says(hours)):
            return "coarse", None
        return "specific", (("indefinite" if says(indefinite) else "fixed") if fixed_term_id and cid == fixed_term_id else None)

    return told


def texts_at(texts: pa.Array, where: np.ndarray) -> list[str | None]:
    return texts.take(pa.array(where, mask=where < 0)).to_pylist()


def wordings(texts: pa.Array, doc: np.ndarray, rule: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of hits in order of document, rule and line: the first one of each document and rule, the number of its wording, and the rule, first and second text of each wording.

    A wording is a rule and the texts of the first two of its lines; the second is -1 if there is only one.
    """
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(rule) != 0)
    head = np.flatnonzero(new)
    last = np.append(head, len(doc))[1:] - 1
    second = np.where(head < last, text[np.minimum(head + 1, last)], -1)
    coded = pa.array((rule[head] * (len(texts) + 1) + text[head]) * (len(texts) + 1) + second + 1).dictionary_encode()
    rest, other = np.divmod(coded.dictionary.to_numpy(zero_copy_only=False), len(texts) + 1)
    of, one = np.divmod(rest, len(texts) + 1)
    return head, coded.indices.to_numpy(zero_copy_only=False), of, one, other - 1


def _spoken(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Adds ``_spoken``: per criterion of the pack what its first two lines say, and the first of them; worked out once per distinct wording of a batch."""
    rules, told, ids = line_rules(pack), findings_of(pack), pa.array(pack.criterion_ids, pa.string())
    width = len(ids)

    def given(n: int, texts: pa.Array, doc, rule, line, text) -> pa.Array:
        head, which, of, one, other = wordings(texts, doc, rule, text)
        said = [told(r, a if b is None else f"{a} {b}") for r, a, b in zip(of.tolist(), texts_at(texts, one), texts_at(texts, other), strict=True)]
        finding, term = (pa.array([*column, None], pa.string()) for column in (zip(*said) if said else ((), ())))
        slot = doc[head] * width + rule[head]

        def place(values, empty):
            out = np.full(n * width, empty, np.int64)
            out[slot] = values
            return out

        first, kind = place(head, -1), place(which, len(said))
        here = lambda values: pa.array(np.append(values, 0)[first], mask=first < 0)
        findings = finding.take(pa.array(kind))
        whole = pa.StructArray.from_arrays(
            [ids.take(pa.array(np.tile(np.arange(width), n))), findings.fill_null("absent"), here(line + 1).cast(pa.int32()), texts.take(here(text)),
             term.take(pa.array(kind))], fields=list(SPOKEN))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), whole)

    @F.arrow_udf("array<struct<criterion_id:string,finding:string,line_no:int,text:string,term_type:string>>")
    def read(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(SPOKEN)), *(given(*step) for step in hits(lists, rules))])

    return docs.withColumn("_spoken", read.asNondeterministic()(F.col("lines")["text"]))


def _claim(s: Column, pack: RulePack) -> Column:
    """The claim that one element of ``_spoken`` makes."""
    quoted = (s["finding"] == "specific") & (s["criterion_id"] == pack.hours_id) if pack.hours_id else F.lit(False)
    none = F.lit(None).cast("string")
    return F.struct(
        s["criterion_id"].alias("criterion_id"), s["finding"].alias("finding"),
        F.when(s["finding"] == "absent", F.array().cast(f"array<{schemas.QUOTE}>")).otherwise(
            F.array(F.struct(s["line_no"].alias("line"), s["text"].alias("text")))).alias("quotes"),
        none.alias("source_value"), s["term_type"].alias("term_type"), F.when(quoted, "quoted").alias("value_kind"),
        F.lit(None).cast(schemas.CALC).alias("calc"))


def rule_extractor(pack: RulePack) -> Callable[[DataFrame], DataFrame]:
    """The default extractor: keyword rules. Adds ``claims``, those of ``classify_finding(first_hits(match_lines(docs, pack)), pack)``."""

    def claims(docs: DataFrame) -> DataFrame:
        build = lambda: F.transform("_spoken", lambda s: _claim(s, pack))
        return _spoken(docs, pack).withColumn("claims", reused(("claims of rules", pack.digest), build)).drop("_spoken")

    return claims


def claim_rows(docs: DataFrame, pack: RulePack, *keep: str) -> DataFrame:
    """The claims of ``rule_extractor`` as rows with ``claim`` and ``lines`` (the cited one): one per document and criterion, absent ones included."""
    each = unnest(_spoken(docs, pack), "_spoken", *keep, "lines", present="criterion_id")
    s = {name: F.col(name) for name in SPOKEN.names}
    return each.select(*keep, F.array(F.get("lines", s["line_no"] - 1)).alias("lines"), _claim(s, pack).alias("claim"))


def extract(docs: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run any extractor that adds ``claims`` in the claim layout to documents with lines."""
    out = extractor(docs)
    want = f"array<{schemas.CLAIM}>".lower()
    have = dict(out.dtypes).get("claims", "missing").lower()
    if have.replace(" ", "") != want.replace(" ", ""):
        raise ValueError(f"extractor must add claims {want}, got {have}")
    return out


def suggest_alias(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Company name if the text clearly shows one, else the default name."""
    text = F.col("text")
    clean = lambda c: F.trim(F.regexp_replace(norm_ws(c), r"[.。]+$", ""))
    bare = lambda c: F.regexp_replace(c, K.CORPORATE_FORM, "")
    fields = F.array_distinct(F.filter(
        F.transform(extract_all(text, K.NAME_FIELD, 1), clean), lambda c: F.length(c) > 0))
    forms = F.filter(F.transform(extract_all(text, K.CORPORATION, 1), clean), lambda c: F.length(bare(c)) >= 2)
    names = F.array_distinct(F.transform(forms, bare))
    found = docs.select(key, fields.alias("fields"), forms.alias("forms"), names.alias("names"))
    # of one name written in several ways the last spelling is shown
    pick = (
        F.when(F.size("fields") == 1, F.get("fields", F.lit(0)))
        .when((F.size("fields") == 0) & (F.size("names") == 1), F.element_at("forms", -1))
    )
    return found.select(
        key,
        F.coalesce(F.substring(pick, 1, K.ALIAS_MAX), F.lit(K.DEFAULT_ALIAS)).alias("alias"),
        F.when(pick.isNotNull(), "suggested").otherwise("default").alias("alias_source"),
    )
