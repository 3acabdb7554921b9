"""Main text of web pages with a site style tree.

Pages of a host are merged by element path (tag and class from the root). A path's importance joins two entropies over the host's
distinct pages: that of the ways in which its children are laid out (presentation), and, at text, that of the content, which is low
when every page has its own and high when all repeat one. A branch goes if its importance is low, if its tag or class says what it is (menu, footer, advert,
comments, ...; a class or form never condemns a branch with an article or most of the text), or, on pages that mark their article, if it stands outside. Importance judges the branches inside a marked
article too; equal articles of a host count once, and where low branches hold most of an article it is a near copy of others and stays whole,
as copies would otherwise erase each other.
"""

from __future__ import annotations

import hashlib
import math
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import table, written
from factsieve.llm.packing import by_bytes

#: Fixed word lists: elements without end tag, elements inside a line of text, elements whose content is never shown as text, noise by tag and by class.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = set("script style noscript template head title iframe object embed svg canvas select option optgroup datalist textarea button audio video map".split())
NOISE_TAGS = set("nav footer aside form menu dialog".split())
NOISE_WORDS = set("ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar "
                  "widget footer cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login comment comments commentlist reply replies discussion "
                  "disqus respond share sharing social related recommended pagination pager toolbar masthead copyright disclaimer gdpr".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ARTICLE = {"article", "main"}
#: Cues under which an article is a comment or a teaser if the page has another, and beginnings of class names that only say what a page has.
ASIDE_WORDS = set("comment comments reply ad advert promo sponsored related".split())
HAS_WORDS = set("has have no not with without is hide show".split())
#: Elements that may stand in a head: any other ends it.
HEAD_TAGS = set("title meta link base style script noscript template basefont bgsound".split())
#: Elements that an open one of the named kind ends by starting.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Least importance of a branch, distinct pages from which on a host's tree is used, and how fast lower levels count less.
LEAST, PAGES, DECAY = 0.2, 5, 0.9
#: Bytes of html parsed before their rows are handed on.
STEP_BYTES = 1 << 20


class PageParser(HTMLParser):
    """Collects blocks (path, text, noise, in article) and layouts (path, children)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []  # tag, path, noise, article, children, hidden, cues
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.cues: list[tuple[int, ...]] = []  # of each block, the branches above it that a cue or form would condemn
        self.aside: list[bool] = []  # of each such branch
        self.articles: list[tuple[int, ...]] = []  # of each article, the same
        self.layouts: list[tuple[str, str]] = []
        self.words: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            top = next((e for e in reversed(self.stack) if e[0] not in INLINE), ["", "", False, False])
            inner = self.stack[-1] if self.stack else top
            self.blocks.append((top[1], text, inner[2], inner[3]))
            self.cues.append(inner[6] if self.stack else ())

    def judge(self) -> None:
        """A cue or form condemns no branch that holds an article or most of the page's text; the style tree is left to judge there."""
        size, held = 0, [0] * len(self.aside)
        for (_path, text, noise, _article), cues in zip(self.blocks, self.cues, strict=True):
            if not noise:
                size += len(text)
                for k in cues:
                    held[k] += len(text)
        true = [cues for cues in self.articles if not any(self.aside[k] for k in cues)]
        spared = {k for cues in true or self.articles for k in cues} | {k for k, n in enumerate(held) if 2 * n > size}
        self.blocks = [(path, text, noise or not spared.issuperset(cues), article) for (path, text, noise, article), cues in zip(self.blocks, self.cues, strict=True)]

    def end_head(self) -> None:
        """Leaves a head that is open, unless what starts stands in a noscript or template of it."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "head":
                self.flush()
                self.leave(i)
                return
            if self.stack[i][0] in HIDDEN:
                return

    def leave(self, keep: int) -> None:
        while len(self.stack) > keep:
            tag, path, _noise, _article, children, _hidden, _cues = self.stack.pop()
            if tag not in INLINE and children:
                self.layouts.append((path, " ".join(children)))

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self.end_head()
        if tag == "br" or tag in VOID:
            self.words.append(" ")
            if tag == "hr":
                self.flush()
            return
        a = dict(attrs)
        if tag not in INLINE:
            self.flush()
            # a block ends an open paragraph, and inline elements left open in it
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p" or self.stack[i][0] in CLOSES.get(tag, ()):
                    self.leave(i)
                    break
                if self.stack[i][0] not in INLINE:
                    break
        _, path, noise, article, _, hidden, cues = self.stack[-1] if self.stack else ("", "", False, False, None, False, ())
        names = f"{a.get('class') or ''} {a.get('id') or ''}".lower()
        words = set(names.split())
        for parts in [[w for w in re.split(r"[^a-z]+", name) if w] for name in names.split()]:
            # the name's first word, or its last one if the first doesn't say that the page has or lacks something
            if parts and parts[0] not in HAS_WORDS:
                words |= {parts[0], parts[-1]}
        style = (a.get("style") or "").replace(" ", "").lower()
        own = (tag in NOISE_TAGS and tag != "form") or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or "display:none" in style
        cue = tag == "form" or bool(words & NOISE_WORDS) or (a.get("role") or "").lower() in NOISE_ROLES or (not article and (tag == "header" or "header" in words))
        if tag in ("html", "body") or (tag in ARTICLE and not words & ASIDE_WORDS):
            own = cue = False  # of the page or its text as a whole, such cues say nothing
        before = noise or bool(cues)
        if cue and not own:
            cues = (*cues, len(self.aside))
            self.aside.append(bool(words & ASIDE_WORDS))
        if tag in INLINE:
            if (own or cue) and not before:
                self.flush()  # the text before a branch of noise in a line stands for itself
            self.stack.append([tag, path, noise or own, article, [], hidden, cues])
            return
        label = tag + "".join(f".{c}" for c in sorted(re.sub(r"\d+", "0", names).split()))
        if self.stack:
            block = next((e for e in reversed(self.stack) if e[0] not in INLINE), None)
            if block and (not block[4] or block[4][-1] != label):
                block[4].append(label)
        marks = tag in ARTICLE and not (noise or own or cue)
        if marks:
            self.articles.append(cues)
        self.stack.append([tag, f"{path}/{label}", noise or own, article or marks, [], hidden or tag in HIDDEN, cues])

    def handle_endtag(self, tag):
        if tag == "br":
            self.words.append(" ")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                noisy = [e[2] or bool(e[6]) for e in self.stack[max(0, i - 1) : i + 1]]
                noisy_inline = tag in INLINE and noisy[-1] and not (i and noisy[0])
                if tag not in INLINE or noisy_inline:
                    self.flush()
                self.leave(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.end_head()
        if not (self.stack and self.stack[-1][5]):
            self.words.append(data)

    def page(self, html: str) -> PageParser:
        self.feed(html)
        self.close()
        self.flush()
        self.leave(0)
        self.judge()
        return self


def dom(pages: DataFrame) -> DataFrame:
    """A row per page: its digest ``copy`` of the article, or of all blocks if none is marked, ``nodes`` and ``blocks``. uid tells rows of the table apart.

    nodes: the page's distinct (kind text or layout, path, feature); first marks one entry of each kind and path, so entries can be counted as pages.
    blocks: what tags and classes let stand, in page order, with the number of its node. The text of noise is not carried on.
    """
    node = pa.list_(pa.struct([("kind", pa.string()), ("path", pa.string()), ("feature", pa.int64()), ("first", pa.bool_())]))
    block = pa.list_(pa.struct([("node", pa.int32()), ("article", pa.bool_()), ("text", pa.string())]))
    names = ["uid", "page_id", "url", "host", "copy", "nodes", "blocks"]

    def digest(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    def of_page(html: str | None) -> tuple[int, list, list]:
        p = PageParser().page(html or "")
        nodes: dict[tuple, int] = {}
        paths: set = set()
        firsts, blocks = [], []

        def number(kind: str, path: str, content: str) -> int:
            key = (kind, path, digest(content))
            if key not in nodes:
                nodes[key] = len(nodes)
                firsts.append((kind, path) not in paths)
                paths.add((kind, path))
            return nodes[key]

        marked = any(article and not noise for _path, _text, noise, article in p.blocks)
        for path, text, noise, article in p.blocks:
            at = number("text", path, text)
            if not noise and (article or not marked):
                blocks.append({"node": at, "article": article, "text": text})
        for path, children in p.layouts:
            number("layout", path, children)
        entries = [{"kind": k, "path": x, "feature": f, "first": first} for (k, x, f), first in zip(nodes, firsts, strict=True)]
        return digest("\n".join(x["text"] for x in blocks) if marked else "\n".join(text for _path, text, _noise, _article in p.blocks)), entries, blocks

    def parse(batches):
        for batch in batches:
            for i, j in by_bytes(batch.column(4), STEP_BYTES):
                part = batch.slice(i, j - i)
                copies, nodes, blocks = zip(*(of_page(html) for html in part.column(4).to_pylist()), strict=True)
                columns = [*part.columns[:4], pa.array(copies, pa.int64()), pa.array(nodes, node), pa.array(blocks, block)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    schema = ("uid long, page_id long, url string, host string, copy long, nodes array<struct<kind: string, path: string, feature: long, first: boolean>>, "
              "blocks array<struct<node: int, article: boolean, text: string>>")
    return pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long"), "url", host.alias("host"), "html").mapInArrow(parse, schema)


def style_tree(rows: DataFrame, decay: float = DECAY, pages: int = PAGES) -> DataFrame:
    """host, path, importance from the rows of ``dom``; hosts with fewer than ``pages`` distinct pages are left out.

    Pages of equal article, or of equal text where none is marked, count once. What reaches the task of a host is one row a path, however many pages it has.
    """
    rows = rows.where("host <> ''")
    one = rows.groupBy("host", "copy").agg(F.min("uid").alias("uid"))
    r = rows.select("uid", "host", "nodes").join(one.select("uid"), "uid", "left_semi").select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    counts = r.groupBy("host", "kind", "path", "feature").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("first").cast("long")).alias("m"))
    paths = counts.groupBy("host", "kind", "path").agg(F.sum("m").alias("m"), F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("clogc"), F.avg(F.ln("c")).alias("meanlog"))
    size = one.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    paths = paths.join(size.where(F.col("pages") >= pages), "host")

    def of_host(frame: pd.DataFrame) -> pd.DataFrame:
        own: dict[str, float] = {}
        for kind, path, m, n, clogc, meanlog in frame[["kind", "path", "m", "n", "clogc", "meanlog"]].itertuples(index=False):
            if m <= 1:
                value = 1.0
            elif kind == "text":
                value = 1 - meanlog / math.log(m)
            else:
                value = (math.log(n) - clogc / n) / math.log(m)
            own[path] = max(own.get(path, 0.0), min(1.0, max(0.0, value)))
        below: dict[str, list[float]] = {}
        whole: dict[str, float] = {}
        for path in sorted(own, key=lambda x: -x.count("/")):
            children = below.get(path, [])
            share = decay ** max(1, len(children))
            whole[path] = (1 - share) * own[path] + share * (sum(children) / len(children)) if children else own[path]
            below.setdefault(path.rpartition("/")[0], []).append(whole[path])
        def of_article(path: str) -> bool:
            return path.rpartition("/")[2].partition(".")[0] in ARTICLE

        # a branch counts no more than the branches it hangs on; root, body and a marked article hold everything and don't judge
        for path in sorted(whole, key=lambda x: x.count("/")):
            above = path.rpartition("/")[0]
            if above.count("/") > 2 and above in whole and not of_article(above) and not of_article(path):
                whole[path] = min(whole[path], whole[above])
        return pd.DataFrame({"host": frame["host"].iloc[0], "path": list(whole), "importance": list(whole.values())})

    return paths.groupBy("host").applyInPandas(of_host, "host string, path string, importance double")


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty html give the empty text; a null url belongs to no host, so only tags and classes judge the page. Repeated rows
    give repeated rows; other columns are ignored. White space inside a block is one space, blocks are joined by one space.
    """
    rows = written(dom(pages), "dom")
    # written first, so that its size is known when the join is planned: the pages are shuffled only if it is too large to be sent to them
    low = written(style_tree(rows).where(F.col("importance") < least).groupBy("host").agg(F.collect_list("path").alias("low")), "low")
    of_host = rows.select("page_id", "url", "host", "nodes", "blocks").join(low, "host", "left")
    path = lambda x: F.get("nodes", x["node"])["path"]
    own = F.transform("blocks", path)
    gone = of_host.withColumn("gone", F.coalesce(F.array_intersect(own, "low"), F.array().cast("array<string>")))
    size = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, x: n + F.length(x["text"]))
    marked = F.filter("blocks", lambda x: x["article"])
    gone = gone.withColumn("copied", size(F.filter(marked, lambda x: F.array_contains("gone", path(x)))) * 2 > size(marked))
    stay = F.filter("blocks", lambda x: (x["article"] & F.col("copied")) | ~F.array_contains("gone", path(x)))
    text = F.array_join(F.transform(stay, lambda x: x["text"]), " ")
    return gone.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
