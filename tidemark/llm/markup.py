"""Main text of web pages by template deduction over the pages of a host.

Every page falls into tokens: container tags and text blocks, each with the path of containers that it stands in. Tokens of a
host that occur equally often on every one of its pages have one occurrence vector; the vector is kept as two sums of
page digests, so that it is as large for a host with most of the pages as for any other, and is summed before the shuffle.
Every occurrence in a page is a token of its own (the n-th of its kind), so a class may interleave what stands twice or more.
Tokens with equal vectors form a class. Classes that are large and frequent enough make up the host's template; a class is
valid on a page if its tokens stand there in the template's order. A class of texts alone that stand equally often, more than
once, nests in a slot of a class of single tokens; other classes need a container tag.
What stands in the slots between template tokens is the page's data; slots in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out, the rest is the main text. Pages of a host
whose main blocks are all the same are copies and count as one page. Inside an article only blocks that every page of a
host of at least ``SURE`` distinct pages repeats count as template.

Defined results: null html has empty text; a null url, or one without a host, belongs to the host ''; pages of any length are
read whole; repeated rows have results of their own; a host with few pages has no template, and its pages are read by their
markup alone; empty tables give empty results; other columns are not read. A line break tag is white space inside its block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.urls import host_of
from tidemark.session import cut_lineage

#: Elements by their role in a page.
RAW = "script style textarea title noscript iframe template svg xmp select object canvas math".split()
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr input button meta link base".split())
OUTSIDE = frozenset("nav aside footer form dialog menu head".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent gdpr notice "
                  "notices sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus replies "
                  "respond share sharing social subscribe newsletter signup popup modal overlay related recommended pagination pager".split())
NEVER_NAMED = frozenset("html body article main".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^<>]*+)>"
    r"|<[!?][^>]*+>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")

LEAST_PAGES, SHARE, SURE = 5, 0.5, 20


@dataclass(frozen=True)
class Block:
    token: int  # digest of the block's path and text, or of a container's path
    text: str | None  # None: a container tag
    inside: bool  # in an article
    outside: bool  # in a region that is no main text


def _digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"), 0) >> 1


def _left_out(name: str, attrs: str, in_main: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_main):
        return True
    if not attrs or name in NEVER_NAMED:
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if (key == "role" and value in ROLES) or (key in ("class", "id") and not NAMES.isdisjoint(WORDS.findall(value))):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Container tags and text blocks of a page in order. Open containers close with their parents; paragraphs and
    inline elements only separate or join text, so unclosed ones do no harm."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # name, path, inside, outside
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            _, path, inside, outside = stack[-1]
            out.append(Block(_digest(path, text), text, inside, outside))

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue  # a comment, a declaration or a raw element
        if name in INLINE:
            if name in ("br", "img"):
                held.append(" ")
            continue
        flush()
        if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "hr"):
            continue
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        _, path, inside, outside = stack[-1]
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.endswith("/"):
            continue
        path = f"{path}/{name}"
        stack.append((name, path, inside or name in MAIN, outside or _left_out(name, attrs, inside)))
        out.append(Block(_digest(path), None, stack[-1][2], stack[-1][3]))
    held.append(page[at:])
    flush()
    return out


def _numbered(found: list[Block]) -> list[int]:
    """Per block its token, from the second occurrence in the page on a digest of token and number."""
    seen: dict[int, int] = {}
    out = []
    for b in found:
        n = seen[b.token] = seen.get(b.token, 0) + 1
        out.append(b.token if n == 1 else _digest(f"{b.token} {n}"))
    return out


def main_text(page: str | None, template: dict[int, tuple[int, float, bool]]) -> str:
    """Text of the slots that are no template. ``template``: token -> (class, place, on every page)."""
    found = blocks(page or "")
    # a class counts on this page only if its tokens stand in the template's order
    last: dict[int, float] = {}
    broken: set[int] = set()
    numbered = _numbered(found)
    for token in numbered:
        if token in template:
            cls, place, _ = template[token]
            if place < last.get(cls, -1.0):
                broken.add(cls)
            last[cls] = max(place, last.get(cls, -1.0))

    def constant(token: int, b: Block) -> bool:
        if token not in template or template[token][0] in broken:
            return False
        return template[token][2] or not b.inside

    at = {id(b): token for token, b in zip(numbered, found)}
    return "\n".join(b.text for b in _slots(found) if not constant(at[id(b)], b))


OCCURRENCE = "host string, token long, pages long, a long, b long, most int, least int, place double, is_text boolean"
FORM = "host string, body long, mark long, tokens binary"
COUNTED = np.dtype([("token", "<i8"), ("n", "<i4"), ("place", "<f4"), ("is_text", "?")])


def _slots(found: list[Block]) -> list[Block]:
    """Text blocks that may be main text: those of an article, or without one all in no region that is left out."""
    slots = [b for b in found if b.text is not None and not b.outside]
    return [b for b in slots if b.inside] or slots


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page the digest of its main blocks, which copies share, and its tokens with their counts."""
    for batch in batches:
        out: dict[tuple[str, int], tuple[int, bytes]] = {}
        for host, page in zip(batch["host"], batch["html"]):
            found = blocks(page or "")
            key, mark = (host, _digest(*[str(b.token) for b in _slots(found)])), _digest(page or "")
            if key in out and out[key][0] <= mark:
                continue
            count = Counter(b.token for b in found)
            rows = [(t, count[b.token], i / len(found), b.text is not None) for i, (t, b) in enumerate(zip(_numbered(found), found))]
            out[key] = mark, np.array(rows, COUNTED).tobytes()
        yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["host", "body", "mark", "tokens"])


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each token's occurrences, summed over the distinct pages of a host in a batch."""
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, body, tokens in zip(batch["host"], batch["body"], batch["tokens"]):
            for token, n, place, is_text in np.frombuffer(tokens, COUNTED).tolist():
                h = _digest(f"{body} {n}")
                s = sums.setdefault((host, token), [0, 0, 0, n, n, 0.0, is_text])
                s[0] += 1
                s[1] += h & 0x3FFFFFFF
                s[2] += h >> 32 & 0x3FFFFFFF
                s[3] = max(s[3], n)
                s[4] = min(s[4], n)
                s[5] += place
        yield pd.DataFrame([(h, t, *v) for (h, t), v in sums.items()], columns=["host", "token", "pages", "a", "b", "most", "least", "place", "is_text"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's valid classes as (token, class, place, sure). Pages with the same main
    blocks count once, so copies make no template of what they share. A token is kept if it is on at least half of the
    host's distinct pages, so a template is no longer than two pages."""
    forms = pages.select("host", "html").mapInPandas(_forms, FORM).groupBy("host", "body").agg(F.min(F.struct("mark", "tokens")).alias("m"))
    forms = cut_lineage(forms.select("host", "body", "m.tokens"))
    sizes = forms.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    found = forms.mapInPandas(_occurrences, OCCURRENCE).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("most").alias("most"), F.min("least").alias("least"),
        (F.sum("place") / F.sum("pages")).alias("place"), F.max("is_text").alias("is_text")).where(F.col("pages") >= LEAST_PAGES)
    often = found.join(sizes, "host").where(F.col("pages") >= SHARE * F.col("all_pages"))
    classed = often.withColumn("class", F.xxhash64("pages", "a", "b"))
    whole = (F.col("pages") == F.col("all_pages")) & (F.col("most") == F.col("least")) & (F.col("all_pages") >= SURE)
    # a class that holds a container tag and another token frames slots
    members = classed.groupBy("host", "class").agg(
        F.collect_list(F.struct("token", "class", "place", whole.alias("sure"))).alias("m"), F.max((~F.col("is_text")).cast("int")).alias("frames"),
        F.max("most").alias("most"), F.min("least").alias("least"), F.max("pages").alias("pages"), F.min("place").alias("start"))
    members = cut_lineage(members.where(F.size("m") > 1))
    valid = members.where("frames = 1")
    # texts that stand equally often on their pages, more than once, nest in a class of single tokens that starts before them
    outer = valid.where("most = 1").groupBy("host").agg(F.collect_list(F.struct("pages", "start")).alias("outer"))
    nested = members.where("frames = 0 AND least > 1 AND least = most").join(outer, "host")
    nested = nested.where(F.exists("outer", lambda o: (o["pages"] >= F.col("pages")) & (o["start"] < F.col("start"))))
    both = valid.select("host", "m").unionByName(nested.select("host", "m"))
    return both.groupBy("host").agg(F.flatten(F.collect_list("m")).alias("template"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.col(url)).alias("host"))
    found = cut_lineage(templates(rows))

    @F.pandas_udf("string")
    def run(html_: pd.Series, template: pd.Series) -> pd.Series:
        known: dict[tuple, dict] = {}
        out = []
        for page, t in zip(html_, template):
            if t is None or not len(t):
                out.append(main_text(page, {}))
                continue
            mark = (len(t), t[0]["token"], t[-1]["token"], t[0]["class"])
            if mark not in known:
                known[mark] = {x["token"]: (x["class"], x["place"], x["sure"]) for x in t}
            out.append(main_text(page, known[mark]))
        return pd.Series(out, dtype=object)

    joined = rows.join(found, "host", "left")
    got = joined.select(F.col("id").alias(key), "url", run("html", "template").alias("text"))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))
